"""Column rules without shuffles: links, opaque ids, request and scope checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values of the rules.
URL_START = r"^https?://"
API_OR_AVATAR_HOST = r"^api\.|\.api\.|avatar"
API_PATH = r"/(api|rest)/"
# Host and path of a link; a host with one of the listed characters makes it no link.
URL_HOST = r"^https?://(?:[^/?#\\@]*@)?([^/?#\\:]*)"
URL_PATH = r"^https?://[^/?#\\]*([^?#]*)"
HOST = r"^[^\s<>^`{|}\[\]%\"]+\z"
IMAGE_PATH = r"(?i)\.(png|jpe?g|gif|svg|webp|ico)\z"
ID_NAME = r"(?i)(?:^|_)id\z"
URL_OR_ID_NAME = r"(?i)(?:^|_)(?:url|id)\z"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
TOKEN_LIKE = r"^[A-Za-z0-9_-]+\z"
PREFIXED_ID = r"^[A-Za-z]{1,10}_[A-Za-z0-9]{6,}\z"
WORD_PART = r"(^|[-_])[A-Za-z]{3,}([-_]|$)"
CHARACTER_RUN = r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+"
SCOPE_QUALIFIER = r"(?i)(?<![A-Za-z0-9_])(?:(?:repo|org|user):|is:pr(?![A-Za-z0-9_]))"
OWNER_SLUG = r"^[A-Za-z0-9-]+\z"
REPO_SLUG = r"^[A-Za-z0-9_.-]+\z"
MAX_SLUG = 100
MAX_QUERY = 512
MAX_PAGE = 34
MIN_BUDGET = 256
MAX_BUDGET = 8192


def machine_url(s: Column) -> Column:
    """Links for programs: API self-links and images. False for a link without a proper host.

    Paths may hold characters that a strict parser refuses, such as spaces and bars.
    """
    host = F.lower(F.regexp_extract(s, URL_HOST, 1))
    path = F.trim(F.regexp_extract(s, URL_PATH, 1))
    hit = host.rlike(HOST) & (host.rlike(API_OR_AVATAR_HOST) | path.rlike(API_PATH) | path.rlike(IMAGE_PATH))
    return F.when(s.rlike(URL_START), F.coalesce(hit, F.lit(False))).otherwise(F.lit(False))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def nested_id(path: Column) -> Column:
    return path.contains(".") & last_segment(path).rlike(ID_NAME)


def is_noise_name(path: Column) -> Column:
    """Names of links and ids: worth a number, not a mention."""
    return last_segment(path).rlike(URL_OR_ID_NAME)


def is_opaque_id(s: Column) -> Column:
    """Machine-made identifiers: UUIDs, prefixed keys and hashes without a readable word."""
    prefixed = s.rlike(PREFIXED_ID)
    body = F.when(prefixed, F.substr(s, F.instr(s, "_") + 1)).otherwise(s)
    # A random id jumps between digits, lower and upper case; each jump starts a new run.
    runs = F.regexp_count(body, F.lit(CHARACTER_RUN))
    random_like = (
        (F.length(s) >= 12) & s.rlike(TOKEN_LIKE) & (prefixed | (F.length(s) >= 16))
        & ~body.rlike(WORD_PART) & (runs >= 5)
    )
    return s.rlike(UUID) | random_like


def scope_conflict(query: Column) -> Column:
    """The query sets a scope that the caller's own arguments define."""
    return query.rlike(SCOPE_QUALIFIER)


def valid_request(owner: Column, repo: Column, query: Column, page: Column, budget: Column) -> Column:
    """Slugs, lengths and ranges of a search request; page and budget are optional."""
    checks = [
        owner.rlike(OWNER_SLUG) & F.length(owner).between(1, MAX_SLUG),
        repo.rlike(REPO_SLUG) & F.length(repo).between(1, MAX_SLUG),
        F.length(query).between(1, MAX_QUERY),
        page.isNull() | page.between(1, MAX_PAGE),
        budget.isNull() | budget.between(MIN_BUDGET, MAX_BUDGET),
    ]
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in checks))
