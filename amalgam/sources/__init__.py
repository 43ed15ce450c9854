"""Sources: from input files (path, content) to records with raw claims and identity hints."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from .delimited import extract_delimited
from .foreign_json import extract_json
from .notes import extract_notes
from .profiles import extract_profiles
from .resumes import extract_resumes

#: Source type to extractor; add to it to read another kind of source.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "recruiter_csv": extract_delimited,
    "ats_json": extract_json,
    "github": extract_profiles,
    "resume": extract_resumes,
    "recruiter_notes": extract_notes,
}
