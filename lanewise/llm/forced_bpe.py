"""BPE encoding by forced boundaries, and decoding (operator 10).

A merge can join two neighbouring bytes only if some token holds them side by side. Byte pairs that
no token holds inside are therefore certain cuts: what stands left and right of one is encoded
independently, and the ids are concatenated. White space is such a cut wherever it stands (no token
has it inside), and so is a word's end mark; inside words the table of pairs from the vocabulary
decides. Pieces between white space recur, so each distinct one is cut and encoded once per task
and looked up afterwards, in tables whose bytes are bounded and which a task's end empties.

Null texts count as empty: no ids, and the empty text decoded. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hold, released

#: A table of known pieces is emptied when its keys and ids take about this many bytes; KEY_BYTES is what a key takes besides its letters.
CACHE_BYTES, KEY_BYTES = 24 << 20, 150
#: What a worker may hold of each table from task to task where encoding is all that it does; a bound in bytes as well.
HOLD_BYTES = 100 << 20
#: The name by which a worker holds its encoder from task to task.
ENCODER = "encoder"
#: Rows are taken in slices of about this many bytes; a longer text is encoded in parts of as many characters, cut at white space.
SLICE_BYTES = 1 << 19
#: The normaliser and the splitter that this encoder reproduces; a file with others is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words in a text that the library is given, and the sign between fragments, which is in no vocabulary.
JOINED, BETWEEN = 500, "\ue000"
_INFO = regex.compile("[\x1c-\x1f]")
_LATIN = regex.compile("[\x00-ɏ]*")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


Ids = tuple[np.ndarray, np.ndarray]


class Places(dict):
    """The place of each key in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        return place


class Known:
    """The ids of the keys met so far, in one array; learn(keys) gives the ids and their number for each of new ones."""

    def __init__(self, learn: Callable[[list[str]], Ids]):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.slots = Places()
        self.pool, self.ids, self.bytes = np.zeros(1 << 10, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 8, np.int64), np.zeros(1 << 8, np.int64)

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        """The array with room for size numbers; room doubles, so that adding costs what is added."""
        return array if size <= len(array) else np.concatenate((array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)))

    def full(self, room: int = 0) -> bool:
        return self.bytes > (room or CACHE_BYTES)

    def _add(self, new: list[str]) -> None:
        """Learns the keys that were given the last places; a table that can't is emptied."""
        have = len(self.slots) - len(new)
        try:
            ids, more = self.learn(new)
        except BaseException:
            self.clear()
            raise
        self.start, self.length = (self._grown(x, have + len(new)) for x in (self.start, self.length))
        self.start[have : have + len(new)] = self.ids + np.cumsum(more) - more
        self.length[have : have + len(new)] = more
        self.pool = self._grown(self.pool, self.ids + len(ids))
        self.pool[self.ids : self.ids + len(ids)] = ids
        self.ids += len(ids)
        self.bytes += sum(map(len, new)) + KEY_BYTES * len(new) + 4 * len(ids)

    def look_up(self, keys: list[str], places: np.ndarray | None = None) -> Ids:
        """All ids of the keys in order, and their number for each key; with places, of keys[p] for each place p."""
        have = len(self.slots)
        slot = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        if more := len(self.slots) - have:
            self._add(list(islice(reversed(self.slots), more))[::-1])
        slot = slot if places is None else slot[places]
        lengths = self.length[slot]
        return self.pool[ragged(self.start[slot], lengths)], lengths


def flat(rows: list[list[int]]) -> Ids:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum())), lengths


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces between white space of all texts, as an array with a dictionary, and the row offsets; pieces may be empty.

    Arrow also splits at the four information separators, which are no white space to the tokenizer; texts that
    hold one are split at blanks and line feeds alone, and their pieces may hold other white space.
    """
    if any(map(_INFO.search, texts)):
        found = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.string()), " ")
    else:
        found = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    return found.flatten().dictionary_encode(), found.offsets.to_numpy()


def text_slices(texts: pa.Array) -> Iterator[list[str]]:
    """The rows as lists of about SLICE_BYTES bytes, null as empty; rows are turned into Python texts a slice at a time."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
        begin = end


def parts(text: str, size: int = 0) -> Iterator[str]:
    """The text in parts of about size characters, each but the last ending where white space begins."""
    size, begin = size or SLICE_BYTES, 0
    while len(text) - begin > size:
        spots = [x for c in " \n" if (x := text.find(c, begin + size)) >= 0]
        if not spots:
            break
        yield text[begin : min(spots)]
        begin = min(spots)
    yield text[begin:]


class ForcedBoundary:
    """Encoder and decoder for one tokenizer file with byte-level pieces, word ends and no decoder."""

    def __init__(self, path: str):
        import json

        # a task has one core; the library's threads, as many as the machine has cores, would each keep memory of their own in every worker
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        known = {"type": "BPE", "unk_token": None, "continuing_subword_prefix": None, "dropout": None, "byte_fallback": False, "ignore_merges": False}
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != SPLITTER or any(model.get(k, v) != v for k, v in known.items()) or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path} has another normaliser, splitter or model than this encoder reproduces")
        if spec.get("decoder") is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has a decoder or added tokens of another kind than this encoder reproduces")
        whole, vocab = Tokenizer.from_file(path), model["vocab"]
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = Tokenizer(BPE(vocab, merges, end_of_word_suffix=self.suffix))
        self.between = max(vocab.values()) + 1
        self.inner = Tokenizer(BPE(vocab | {BETWEEN: self.between}, merges))
        self.last.pre_tokenizer = self.inner.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(self.between + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(self.suffix)]] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.words = regex.compile("\n|" + WORD_PATTERN)
        self.to_marks = self._byte_marks()
        from_marks = {chr(c): b for b, c in self.to_marks.items()}
        self.held = np.zeros((256, 256), bool)
        for token in vocab:
            body = [from_marks[c] for c in token.removesuffix(self.suffix)]
            self.held[body[:-1], body[1:]] = True
        self.line_mark = chr(self.to_marks[10])
        names = {**{v: k for k, v in vocab.items()}, **{v: k for k, v in self.special.items()}}
        shown = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.shown_length = np.fromiter(map(len, shown), np.int64, len(shown))
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.known_pieces, self.known_words, self.room = Known(self.encode_pieces), Known(self.encode_words), 0

    @staticmethod
    def _byte_marks() -> dict[int, int]:
        """The public byte-to-character table: printable Latin-1 stands for itself, other bytes for 256 and on, in order."""
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(itself)]
        return {b: b for b in itself} | {b: 256 + i for i, b in enumerate(rest)}

    @staticmethod
    def _joined(coder, words: list[str]) -> np.ndarray:
        """All ids of words (without white space), many in one text, since each text costs the library an object."""
        found = coder.encode_batch_fast([" ".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)], add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in found]) if found else np.zeros(0, np.uint32)

    def encode_marked(self, words: list[str], cuts: list[list[int]]) -> Ids:
        """The ids of words (a character for each byte) and their number for each, in fragments between certain cuts.

        Only a word's last fragment bears its end; so of the ids of all last fragments those that end a
        word tell them apart, and the fragments before them are told apart by a sign of their own.
        """
        tails = self._joined(self.last, [w[c[-1] :] if c else w for w, c in zip(words, cuts, strict=True)])
        many = np.diff(np.flatnonzero(self.ends[tails]), prepend=-1)
        some = [i for i, c in enumerate(cuts) if c]
        if not some:
            return tails, many
        heads = self._joined(self.inner, [x for i in some for x in (*(words[i][a:b] for a, b in zip([0, *cuts[i]], cuts[i], strict=False)), BETWEEN)])
        few = np.diff(np.flatnonzero(heads == self.between), prepend=-1) - 1
        heads = heads[heads != self.between]
        start, length = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        length[some, 0], length[:, 1] = few, many
        start[some, 0], start[:, 1] = np.cumsum(few) - few, len(heads) + np.cumsum(many) - many
        return np.concatenate((heads, tails))[ragged(start.reshape(-1), length.reshape(-1))], length.sum(axis=1)

    def cuts(self, lines: bytes) -> list[list[int]]:
        """The certain cuts of the words in lines: between two bytes of a word that no token holds side by side."""
        raw = np.frombuffer(lines, np.uint8)
        end = raw == 10
        place = np.flatnonzero(~self.held[raw[:-1], raw[1:]] & ~end[:-1] & ~end[1:]) + 1
        starts = np.concatenate(([0], np.flatnonzero(end) + 1))
        word = np.searchsorted(starts, place, "right") - 1
        out: list[list[int]] = [[] for _ in starts]
        for w, c in zip(word.tolist(), (place - starts[word]).tolist(), strict=True):
            out[w].append(c)
        return out

    def encode_words(self, words: list[str]) -> Ids:
        """The ids of normalised words without a line feed; a line feed alone has none."""
        lines = "\n".join(words).encode()
        if "\n" not in words:
            return self.encode_marked(lines.decode("latin-1").translate(self.to_marks).split(self.line_mark), self.cuts(lines))
        at = words.index("\n")
        ids, lengths = self.encode_words(words[:at] + words[at + 1 :]) if len(words) > 1 else flat([])
        return ids, np.insert(lengths, at, 0)

    def encode_latin(self, pieces: list[str]) -> Ids:
        """The ids of pieces in Latin letters without special tokens, normalised here as the library would."""
        words = self.words.findall("\n".join(pieces).lower())
        ids, lengths = self.known_words.look_up(words)
        piece = np.cumsum(np.fromiter((w == "\n" for w in words), bool, len(words)))
        return ids, np.bincount(piece, weights=lengths, minlength=len(pieces)).astype(np.int64)

    def encode_other(self, piece: str) -> list[int]:
        """The ids of a piece that may hold special tokens or any letters; these are normalised and split by the library."""
        out: list[int] = []
        for part in self.special_cut.split(piece) if self.special_cut else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif words := [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]:
                back = {c: b for b, c in self.to_marks.items()}
                lines = [bytes(back[ord(c)] for c in w) for w in words]
                out += self.encode_marked(words, [self.cuts(line)[0] for line in lines])[0].tolist()
        return out

    def encode_pieces(self, pieces: list[str]) -> Ids:
        """The ids of pieces without white space; special tokens are cut out first."""
        other = [i for i, p in enumerate(pieces) if not (p.isascii() or _LATIN.fullmatch(p)) or (self.special_cut and "<" in p and self.special_cut.search(p))]
        if not other:
            return self.encode_latin(pieces)
        gone = set(other)
        latin = [i for i in range(len(pieces)) if i not in gone]
        ids, few = self.encode_latin([pieces[i] for i in latin]) if latin else flat([])
        more, many = flat([self.encode_other(pieces[i]) for i in other])
        place = np.array(latin + other)
        lengths, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        lengths[place] = np.concatenate((few, many))
        start[place] = np.cumsum(lengths[place]) - lengths[place]
        return np.concatenate((ids, more))[ragged(start, lengths)], lengths

    def encode(self, texts: list[str]) -> Ids:
        """All ids of the texts, and the row offsets."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            ids = np.concatenate([self._encode([p])[0] for p in parts(texts[0])])
            return ids, np.array([0, len(ids)])
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> Ids:
        for known in (self.known_pieces, self.known_words):
            if known.full(self.room):
                known.clear()
        pieces, offsets = split(texts)
        ids, lengths = self.known_pieces.look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy())
        return ids, np.concatenate(([0], np.cumsum(lengths)))[offsets]

    def forget(self) -> None:
        """Empties the tables of known pieces; they are filled anew by the next task."""
        self.known_pieces.clear()
        self.known_words.clear()

    def until_end(self, batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[pa.RecordBatch]:
        """The batches of a task, whose tables hold so many bytes each and stay for the next task; with 0 they are small and emptied at the end."""
        self.room = hold
        yield from released(batches, None if hold else self.forget, ENCODER)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text that the library decodes the ids to: the tokens as they stand, joined by blanks."""
        if not len(ids):
            return b""
        return self.shown[ragged(self.shown_start[ids], self.shown_length[ids])].tobytes()[:-1]


@lru_cache(maxsize=2)
def _encoder(path: str) -> ForcedBoundary:
    return ForcedBoundary(path)


def forced_boundary(path: str) -> ForcedBoundary:
    """The worker's encoder, which it holds until it goes on to other work."""
    hold(ENCODER, _encoder.cache_clear)
    return _encoder(path)


def encode_column(text: Column | str, path: str) -> Column:
    """ids array<int> of each whole text."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches, lambda: forced_boundary(path).forget(), ENCODER):
            found = [forced_boundary(path).encode(rows) for rows in text_slices(texts)]
            ids = np.concatenate([p[0] for p in found] or [np.zeros(0, np.uint32)]).astype(np.int32)
            sizes = np.concatenate([np.diff(p[1]) for p in found] or [np.zeros(0, np.int64)])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))

    return encoded(text)


def decode_column(ids: Column | str, path: str) -> Column:
    """The decoded text of each array of ids; null ids count as none."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([forced_boundary(path).decode(np.array(r or [], np.int64)).decode() for r in rows.to_pylist()], pa.string())

    return decoded(ids)


def round_trip(docs: DataFrame, path: str, with_ids: bool = False, hold: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, the little-endian unsigned 32-bit ids) of each row of docs.

    Encodes each whole text and decodes the ids again in one pass. Repeated rows give repeated rows,
    an empty table an empty one; columns besides doc_id and text are not read. hold says how many bytes
    of each table of known pieces a worker may keep from task to task (see until_end); results are the same.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = forced_boundary(path)
        for batch in coder.until_end(batches, hold):
            at = 0
            for rows in text_slices(batch.column(1)):
                ids, ends = coder.encode(rows)
                ids = ids.astype("<u4")
                own = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                cols = [
                    batch.column(0).slice(at, len(rows)),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in own], pa.string()),
                ]
                if with_ids:
                    cols.append(pa.array([x.tobytes() for x in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])
                at += len(rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, schema)
