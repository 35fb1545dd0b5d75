"""The small fixed tables: jurisdictions, reason codes, palette, colour words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Province, issuer number, licence pattern, time zone.
JURISDICTIONS = [
    ("ON", "636012", r"^[A-Z]\d{14}$", "America/Toronto"),
    ("QC", "604428", r"^[A-Z]\d{12}$", "America/Toronto"),
    ("BC", "636028", r"^\d{7,8}$", "America/Vancouver"),
    ("AB", "604432", r"^(?:\d{6,9}|[A-Z]{1,2}\d{4,5})$", "America/Edmonton"),
    ("MB", "636048", r"^(?:[A-Z][A-Z*]{4}[A-Z][A-Z*][A-Z0-9]{5,6}|[A-Z]\d{12,13})$", "America/Winnipeg"),
    ("SK", "636044", r"^\d{8}$", "America/Regina"),
    ("NB", "636017", r"^\d{1,7}$", "America/Moncton"),
    ("NS", "636013", r"^[A-Z][A-Z* ]{4}\d{9}$", "America/Halifax"),
    ("NL", "636016", r"^[A-Z]\d{9}$", "America/St_Johns"),
    ("PE", "604426", r"^\d{1,6}$", "America/Halifax"),
    ("YT", "604429", r"^\d{1,6}$", "America/Whitehorse"),
    ("NT", "604434", r"^\d{5,9}$", "America/Edmonton"),
    ("NU", "604433", r"^\d{5,6}$", "America/Iqaluit"),
]
PROVINCES = [j[0] for j in JURISDICTIONS]
#: Former codes that stand for a present one.
PROVINCE_ALIASES = {"NF": "NL"}
MIN_AGE = 18

# Code, whether a better photo could change it, message.
REASON_CODES = [
    ("BARCODE_UNREADABLE", True, "The barcode on the back of your licence is not clearly visible. Please retake the photo of the barcode."),
    ("BARCODE_NOT_AAMVA", True, "The barcode on your licence is not in a supported format. Please photograph the barcode on the back again."),
    ("FACE_NOT_FOUND_SELFIE", True, "No face was found in your selfie. Please retake it with your face clearly visible."),
    ("FACE_NOT_FOUND_LICENCE", True, "No face was found on the front of your licence. Please retake the photo of the licence front."),
    ("IMAGE_QUALITY", True, "An image is too unclear or shows more than one person. Please retake the photo."),
    ("PLATE_NOT_FOUND", True, "No licence plate was found in the vehicle photo. Please retake it with the plate clearly visible."),
    ("PLATE_UNREADABLE", True, "The licence plate could not be read reliably. Please retake the photo closer to the plate."),
    ("LIVENESS_FAILED", True, "The selfie did not pass the live-person check. Please retake it in good light, without a screen or printed photo."),
    ("JURISDICTION_MISMATCH", False, "The issuing province does not match the province on the licence barcode."),
    ("NAME_MISMATCH", False, "The name given does not match the name on the licence."),
    ("DOB_MISMATCH", False, "The date of birth given does not match the licence."),
    ("LICENCE_NUMBER_MISMATCH", False, "The licence number given does not match the licence."),
    ("LICENCE_EXPIRED", False, "The licence has expired."),
    ("UNDERAGE", False, "The licence holder is under the minimum age."),
    ("FACE_MISMATCH", False, "The selfie does not match the face on the licence."),
    ("PLATE_MISMATCH", False, "The licence plate in the photo does not match the plate given."),
    ("CLASS_MISMATCH", False, "The licence class given does not match the licence."),
    ("ISSUE_DATE_MISMATCH", False, "The issue date given does not match the licence."),
    ("EXPIRY_DATE_MISMATCH", False, "The expiry date given does not match the licence."),
    ("LICENCE_NOT_YET_VALID", False, "The licence issue date is in the future."),
]

# Name, hex, L, a, b.
PALETTE = [
    ("Black", "#111111", 12.0, 0.0, 0.0),
    ("Dark Charcoal / Graphite", "#2e2e33", 24.0, -0.5, -2.0),
    ("Grey", "#6b6f76", 48.0, -0.5, -2.0),
    ("Silver / Metallic", "#c0c4c8", 78.0, -0.8, -1.5),
    ("White", "#f5f6f8", 96.0, -0.5, -0.5),
    ("Deep Navy Blue", "#122036", 16.0, 4.0, -22.0),
    ("Blue", "#1d589e", 38.0, 8.0, -42.0),
    ("Light Blue", "#6da6db", 68.0, -6.0, -30.0),
    ("Red", "#b31b1b", 38.0, 60.0, 38.0),
    ("Maroon / Burgundy", "#4a121a", 20.0, 32.0, 12.0),
    ("Green", "#1b5e20", 35.0, -38.0, 26.0),
    ("Yellow / Gold", "#fbc02d", 78.0, 4.0, 75.0),
    ("Orange", "#e65100", 52.0, 52.0, 60.0),
    ("Brown", "#4e342e", 28.0, 12.0, 12.0),
]

# Colour word, palette names of its family.
COLOUR_WORDS = {
    "black": ["Black"],
    "grey": ["Grey", "Dark Charcoal / Graphite"],
    "gray": ["Grey", "Dark Charcoal / Graphite"],
    "charcoal": ["Dark Charcoal / Graphite", "Grey"],
    "graphite": ["Dark Charcoal / Graphite", "Grey"],
    "silver": ["Silver / Metallic", "Grey"],
    "white": ["White"],
    "blue": ["Blue", "Light Blue", "Deep Navy Blue"],
    "navy": ["Deep Navy Blue"],
    "red": ["Red", "Maroon / Burgundy"],
    "maroon": ["Maroon / Burgundy"],
    "burgundy": ["Maroon / Burgundy"],
    "green": ["Green"],
    "yellow": ["Yellow / Gold"],
    "gold": ["Yellow / Gold"],
    "orange": ["Orange"],
    "brown": ["Brown"],
}
#: Quality of each kind of stored picture in the compressed tier.
COMPRESSED_QUALITY = [("selfie", 80), ("licence_front", 70), ("licence_back", 70), ("vehicle", 85)]


def jurisdictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JURISDICTIONS, "province string, iin string, licence_pattern string, tz string")


def reason_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASON_CODES, "code string, retryable boolean, message string")


def palette(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PALETTE)]
    return spark.createDataFrame(rows, "ord int, name string, hex string, l double, a double, b double")


def colour_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COLOUR_WORDS.items()), "word string, family array<string>")
