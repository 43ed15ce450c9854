"""The regular expressions that extraction results depend on, in Java's syntax.

(?U) gives \\w, \\s, \\d and \\b their Unicode meaning, (?d) makes the line feed the only line end.
"""

# An address starts where a run of its characters does, or where the address before it ends:
# said outright, so that a long run without @ is read once and not from each of its characters.
EMAIL = r"(?i)(?:\G|(?<![A-Z0-9._%+\-]))[A-Z0-9._%+\-]++@[A-Z0-9.\-]+\.[A-Z]{2,}"
PHONE = r"(?U)\+?\d[\d\-.\s()]{7,}\d"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9\-_%]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9\-_]+"
GITHUB_USER = r"(?i)github\.com/([A-Za-z0-9\-_]+)"
GITHUB_LINE = r"(?i)https?://(www\.)?github\.com/"
# What may stand before the number has no bearing on it.
YEARS = r"(?iU)(\d{1,2})\+?\s*(?:years|yrs|yoe)\b"
TITLE_AT = r"(?U)\b([A-Z][A-Za-z+/ ]{2,40}?)\s+(?:at|@)\s+([A-Z][A-Za-z0-9&.\- ]{1,40})"
SKILLS_CUE = r"(?idU)(?:strong in|skills?(?:\s*[:\-])|experienced in|proficient in|expertise in)\s+(.+?)(?:[.\n]|$)"
LOCATION_CUE = r"(?iU)(?:based in|located in|lives in|location[:\-]?)\s+([A-Z][A-Za-z\- ]+(?:,\s*[A-Za-z\- ]+){0,2})"
NAME_CUE = r"(?U)(?:spoke (?:with|to)|call(?:ed)? with|met with|candidate[:\-]?|re[:\-]?|chatted with)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})"
NAME_START = r"(?U)\A([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
NAME_LINE = r"(?U)\A[A-Z][A-Za-z.\-]+(?:\s+[A-Z][A-Za-z.\-]+){1,3}\z"
JOB_LINE = (
    r"(?iU)\A([A-Z][\w&.\-/+ ]{2,50}?)\s*[,–—|@\-]\s*([A-Z][\w&.\-/+ ]{2,50}?)\s*[\(\[|\-–—]?\s*"
    r"((?:[A-Za-z]{3,9}\.?\s*)?\d{4}(?:[-/]\d{1,2})?)\s*[-–—to ]+\s*(present|current|(?:[A-Za-z]{3,9}\.?\s*)?\d{4}(?:[-/]\d{1,2})?)"
)
DEGREE = r"(?iU)\b(?:B\.?S\.?|B\.?Tech|M\.?S\.?|M\.?Tech|Ph\.?D|Bachelor|Master|MBA|B\.?A\.?|M\.?A\.?)[\w.]*"
STUDIED = r"(?dU)\bin\s+([A-Z][A-Za-z &]+?)(?:,|\(|$|\s+\d)"
CENTURY_YEAR = "(19|20)[0-9]{2}"
BULLETS = "^[•*\\-]+"
