"""Lookup tables, trust figures and word lists that results depend on."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in dates.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}

#: Words for an open end date.
PRESENT = ["present", "current", "now", "ongoing", "today"]

#: Country names and aliases, and their ISO 3166 codes.
COUNTRIES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.a.": "US", "u.s.": "US", "us": "US", "america": "US",
    "united kingdom": "GB", "uk": "GB", "u.k.": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "india": "IN", "bharat": "IN",
    "canada": "CA", "germany": "DE", "deutschland": "DE", "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL", "the netherlands": "NL", "holland": "NL",
    "ireland": "IE", "australia": "AU", "new zealand": "NZ", "singapore": "SG", "japan": "JP", "china": "CN", "brazil": "BR", "mexico": "MX", "poland": "PL",
    "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "switzerland": "CH", "portugal": "PT", "austria": "AT", "belgium": "BE", "israel": "IL",
    "united arab emirates": "AE", "uae": "AE", "south africa": "ZA",
}

#: Cities that give their country away.
CITIES = {
    "london": "GB", "manchester": "GB", "san francisco": "US", "new york": "US", "seattle": "US", "boston": "US", "austin": "US",
    "bengaluru": "IN", "bangalore": "IN", "mumbai": "IN", "delhi": "IN", "toronto": "CA", "berlin": "DE", "munich": "DE", "paris": "FR",
    "amsterdam": "NL", "dublin": "IE", "sydney": "AU", "singapore": "SG", "tokyo": "JP", "tel aviv": "IL", "zurich": "CH",
}

#: Parts of names that stay in lower case.
PARTICLES = ["de", "van", "von", "der", "den", "del", "la", "di", "da"]

#: Skills and their aliases; a skill's own name counts too, whatever its case.
SKILLS = {
    "Python": ["py"], "JavaScript": ["js", "java script", "ecmascript"], "TypeScript": ["ts"], "Java": [],
    "C++": ["cpp", "c plus plus"], "C": [], "C#": ["c sharp", "csharp", "dotnet c#"], "Go": ["golang"], "Rust": [], "Ruby": [], "PHP": [],
    "Scala": [], "Kotlin": [], "Swift": [], "R": [], "SQL": [],
    "React": ["react.js", "reactjs", "react js"], "Node.js": ["node", "nodejs", "node js"], "Angular": ["angular.js", "angularjs"], "Vue.js": ["vue", "vuejs"],
    "Django": [], "Flask": [], "Spring": ["spring boot", "springboot"], "Express": ["express.js", "expressjs"],
    "PostgreSQL": ["postgres", "postgresql", "psql"], "MySQL": [], "MongoDB": ["mongo"], "Redis": [], "Elasticsearch": ["elastic search", "es"], "Kafka": ["apache kafka"],
    "Docker": [], "Kubernetes": ["k8s", "kube"], "AWS": ["amazon web services"], "Google Cloud": ["gcp", "google cloud platform"], "Azure": ["microsoft azure"], "Terraform": [],
    "GraphQL": ["graph ql"], "REST APIs": ["rest", "restful", "rest api", "restful apis"],
    "Machine Learning": ["ml"], "Deep Learning": ["dl"], "NLP": ["natural language processing"], "TensorFlow": ["tensor flow"], "PyTorch": ["torch"],
    "Pandas": [], "NumPy": ["numpy"], "Distributed Systems": ["distributed computing", "distributed system"],
    "Microservices": ["micro services", "micro-services"], "CI/CD": ["cicd", "ci cd", "continuous integration"], "Git": [], "Linux": [],
}

#: Trust in each source type, by field; "_default" for the rest. Unknown types have 0.5 throughout.
TRUST = {
    "recruiter_csv": {"_default": 0.80, "full_name": 0.85, "emails": 0.90, "phones": 0.90, "experience": 0.75, "headline": 0.75, "skills": 0.30},
    "ats_json": {"_default": 0.85, "full_name": 0.88, "emails": 0.92, "phones": 0.88, "skills": 0.80, "experience": 0.85, "education": 0.85, "years_experience": 0.80, "location": 0.80, "links": 0.85, "headline": 0.80},
    "github": {"_default": 0.55, "full_name": 0.60, "links": 0.95, "skills": 0.70, "headline": 0.60, "location": 0.55, "emails": 0.70},
    "resume": {"_default": 0.65, "full_name": 0.70, "emails": 0.80, "phones": 0.75, "skills": 0.78, "experience": 0.80, "education": 0.82, "headline": 0.65, "years_experience": 0.55, "location": 0.60, "links": 0.70},
    "recruiter_notes": {"_default": 0.35, "full_name": 0.45, "emails": 0.55, "phones": 0.55, "skills": 0.40, "headline": 0.40, "location": 0.40, "years_experience": 0.35},
}
UNKNOWN_TRUST = 0.5

#: Certainty of each extraction method; unknown methods have 0.6.
CERTAINTY = {
    "csv_column": 0.98, "ats_field_map": 0.97, "json_field": 0.95, "github_api": 0.95, "resume_section": 0.85, "resume_regex": 0.78,
    "regex_email": 0.92, "regex_phone": 0.88, "regex_freetext": 0.62, "heuristic": 0.55,
}
UNKNOWN_CERTAINTY = 0.6

#: Source types from the one that wins ties to the one that loses them; unknown types come after.
PRIORITY = ["ats_json", "recruiter_csv", "resume", "github", "recruiter_notes"]

#: Fields with a basis for the overall confidence, in the order they are resolved, and their weights.
WEIGHTS = {"full_name": 3.0, "headline": 1.0, "years_experience": 0.5, "emails": 3.0, "phones": 1.5, "skills": 1.5, "location": 1.0, "links": 0.5, "experience": 1.5, "education": 1.0}

#: Basis points: what each further agreeing source type adds, the margin within which a rival makes a conflict, and the cap. A conflict costs 15 %.
AGREEMENT_BP, CONFLICT_MARGIN_BP, CAP_BP, CONFLICT_PENALTY = 500, 800, 9900, 0.15

#: Words that do not name a user in a profile address: among listed addresses, and in identity hints.
RESERVED_LISTED = ["orgs", "about", "features"]
RESERVED_HANDLES = ["orgs", "about", "features", "settings", "marketplace", "sponsors"]

#: Header words that mark a document as a resume, and the sections its headers open.
RESUME_WORDS = ["experience", "work experience", "education", "skills", "employment", "professional summary", "projects"]
SECTIONS = {
    "skills": "skills", "technical skills": "skills", "core skills": "skills", "technologies": "skills",
    "experience": "experience", "work experience": "experience", "employment": "experience", "professional experience": "experience",
    "education": "education", "academic background": "education",
}
TITLE_WORDS = "engineer|developer|manager|scientist|lead|architect|intern|analyst|designer"
FILLER_WORDS = "currently|current|now|previously|formerly|present"

#: Accepted headers of delimited files, in order of preference.
HEADERS = {
    "name": ["name", "full_name", "candidate", "candidate_name"],
    "email": ["email", "e-mail", "email_address"],
    "phone": ["phone", "phone_number", "mobile", "tel"],
    "company": ["current_company", "company", "employer", "organization"],
    "title": ["title", "job_title", "role", "position"],
}

#: Paths of each field in foreign JSON, in order of preference.
JSON_PATHS = {
    "full_name": ["applicant_name", "name", "full_name", "candidate_name"],
    "emails": ["contact.email_address", "email", "emails", "contact.email"],
    "hint_emails": ["contact.email_address", "email", "emails"],
    "phones": ["contact.mobile", "contact.phone", "phone", "mobile", "phones"],
    "headline": ["headline", "job_title", "title", "current_title"],
    "years_experience": ["experience_years", "years_experience", "yoe"],
    "location": ["location", "locale", "city", "current_location"],
    "links.linkedin": ["social.linkedin_url", "linkedin", "linkedin_url"],
    "links.github": ["social.github_url", "github", "github_url"],
    "links.portfolio": ["social.website", "website", "portfolio"],
    "skills": ["skill_tags", "skills", "competencies"],
    "experience": ["history", "work_history", "experience", "positions"],
    "education": ["schools", "education", "degrees"],
}
JSON_JOB = {"company": ["org", "company", "employer"], "title": ["role", "title", "position"], "start": ["from", "start", "start_date"], "end": ["to", "end", "end_date"], "summary": ["summary", "description"]}
JSON_SCHOOL = {"institution": ["name", "institution", "school"], "degree": ["degree", "qualification"], "field": ["major", "field", "field_of_study"], "end_year": ["grad", "end_year", "graduation_year"]}
JSON_LISTS = ["candidates", "results", "applicants", "data"]


def lookup(table: dict, key: Column) -> Column:
    """The table's value for key, null if there is none. The map is a literal, so Catalyst folds it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def skill_aliases() -> dict[str, str]:
    """Lower-case alias to skill; later entries win, as each skill's own name does over earlier aliases."""
    return {alias: name for name, aliases in SKILLS.items() for alias in [name.lower(), *aliases]}


def base_points(source_type: str, field: str, method: str) -> int:
    """Trust times certainty in basis points; both have two decimals, so this is exact."""
    own = TRUST.get(source_type, {})
    trust = own.get(field.split(".")[0], own.get("_default", UNKNOWN_TRUST))
    return round(trust * 100) * round(CERTAINTY.get(method, UNKNOWN_CERTAINTY) * 100)


def base_confidence(source_type: Column, field: Column, method: Column) -> Column:
    """base_points() of three columns, as one expression over literal maps."""
    pairs = {f"{s}/{f}": round(v * 100) for s, t in TRUST.items() for f, v in t.items()}
    top = F.substring_index(field, ".", 1)
    trust = F.coalesce(lookup(pairs, F.concat_ws("/", source_type, top)), lookup(pairs, F.concat_ws("/", source_type, F.lit("_default"))), F.lit(round(UNKNOWN_TRUST * 100)))
    certainty = F.coalesce(lookup({k: round(v * 100) for k, v in CERTAINTY.items()}, method), F.lit(round(UNKNOWN_CERTAINTY * 100)))
    return (trust * certainty).cast("int")


def priority(source_type: Column) -> Column:
    """Rank of a source type in ties, from 0; unknown types share the last rank."""
    at = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), source_type)
    return F.when(at > 0, at - 1).otherwise(len(PRIORITY)).cast("int")


def source_type_of(source: Column) -> Column:
    return F.substring_index(source, ":", 1)
