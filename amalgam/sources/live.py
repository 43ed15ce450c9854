"""Profiles from a web service, where a run asks for them."""

import json
import urllib.parse
import urllib.request

import pyarrow as pa

#: The public service, what it is asked for, and how many repositories count towards a user's languages.
SERVICE = "https://api.github.com"
PROFILE_PATH, REPOSITORIES_PATH = "/users/{}", "/users/{}/repos?per_page=100&sort=pushed"
REPOSITORIES = 30
TIMEOUT = 6.0
HEADERS = {"User-Agent": "amalgam", "Accept": "application/vnd.github+json"}


def ask(url: str):
    with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=TIMEOUT) as answer:
        return json.load(answer)


def profile(service: str, user: str) -> str | None:
    """The profile of a user as JSON, with the languages of the repositories that were pushed to last; null if the service does not give it."""
    name = urllib.parse.quote(user, safe="")
    try:
        found = ask(service + PROFILE_PATH.format(name))
        repositories = ask(service + REPOSITORIES_PATH.format(name)) or []
        used = (r.get("language") for r in repositories[:REPOSITORIES])
        return json.dumps({**found, "_languages": list(dict.fromkeys(x for x in used if x))})
    except Exception:  # noqa: BLE001 - no answer, or not of the expected form: the user is left out
        return None


def fetch(service: str):
    """A function over Arrow batches of users, to (user, content)."""

    def read(batches):
        for batch in batches:
            users = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.string()), pa.array([profile(service, u) for u in users], pa.string())], names=["user", "content"])

    return read
