"""Lists of profile addresses, looked up in cached profiles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import tables as T
from ..functions.text import distinct_ignoring_case, let, strip
from . import claims as C
from .live import fetch

CACHE_FOLDER = "github_cache"
PROFILE = "struct<login:string,name:string,bio:string,company:string,blog:string,location:string,email:string,_languages:array<string>>"


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def listed_users(files: DataFrame) -> DataFrame:
    """(path, folder, rec_idx, user): the users that each list names, first spelling first, reserved words left out."""
    found = F.regexp_extract_all(F.col("content"), F.lit(P.GITHUB_USER), 1)
    users = F.filter(let(found, distinct_ignoring_case), lambda u: ~F.lower(u).isin(T.RESERVED_LISTED))
    return files.select("path", folder(F.col("path")).alias("folder"), F.posexplode(users).alias("rec_idx", "user"))


def cached_profiles(files: DataFrame) -> DataFrame:
    """(folder, user, profile) from (path, content) of the cache files beside the lists."""
    stem = F.regexp_extract("path", r"([^/]*)\.json$", 1)
    profile = F.from_json("content", PROFILE)
    return files.select(folder(folder(F.col("path"))).alias("folder"), stem.alias("user"), profile.alias("p")).where("p IS NOT NULL AND user <> ''")


def fetched(missing: DataFrame, service: str) -> DataFrame:
    """(folder, user, p) of the users that a service knows. Executors ask, each user once; what fails is left out."""
    answers = missing.select("user").distinct().mapInArrow(fetch(service), "user string, content string")
    return missing.join(answers, "user").select("folder", "user", F.from_json("content", PROFILE).alias("p")).where("p IS NOT NULL")


def find_cache(files: DataFrame) -> DataFrame:
    """Cache files of the folders that the lists lie in: (path, content), paths spelled as the lists' are. Only the folders come to the driver, which lists them."""
    from .files import listed, read_files

    spark = files.sparkSession
    folders = [r[0] for r in files.select(folder(F.col("path"))).distinct().collect()]
    return read_files(spark, sorted(x for f in folders for x in listed(spark, f"{f}/{CACHE_FOLDER}")[1] if x.endswith(".json"))).select("path", "content")


def extract_profiles(files: DataFrame, cache: DataFrame | None = None, service: str | None = None) -> DataFrame:
    """A record for each listed user with a cached profile. Users without one are left out, or asked for at a service if one is given."""
    known = cached_profiles(find_cache(files) if cache is None else cache)
    users = listed_users(files)
    if service:
        missing = users.join(known.select("folder", "user"), ["folder", "user"], "left_anti").select("folder", "user").distinct()
        known = known.unionByName(fetched(missing, service))
    p = F.col("p")
    joined = users.join(known, ["folder", "user"])
    method = "github_api"
    blog, company = strip(p["blog"]), strip(F.regexp_replace(p["company"], "^@+", ""))
    login = F.when(p["login"] != "", p["login"])
    made = [
        C.text("full_name", method, p["name"]),
        C.text("headline", method, p["bio"]),
        C.text("location", method, p["location"]),
        C.text("emails", method, p["email"]),
        C.text("links.github", method, F.concat(F.lit("https://github.com/"), login)),
        C.text("links.portfolio", method, F.when(blog != "", F.when(blog.startswith("http"), blog).otherwise(F.concat(F.lit("https://"), blog)))),
        C.texts("skills", method, p["_languages"]),
        C.jobs(method, F.when(company != "", F.array(C.job(company, F.lit(None).cast("string"))))),
    ]
    emails = F.when(F.coalesce(p["email"], F.lit("")) != "", F.array(p["email"]))
    return C.records(joined, "github", made, emails, p["name"], F.lower(login), None, F.col("rec_idx"))
