"""Who may read what: client policies, audience scopes, and views of a corpus that hold only what is visible."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Reasons of a decision, in the order in which they are tried.
REASONS = ("disabled", "invalid_path", "reserved_path", "denied", "allowed", "no_grant")


@dataclass(frozen=True)
class Rule:
    """A directory (all below it; "" is everything) or one file; role reader or editor counts for grants only."""

    id: str
    directory: str | None = None
    file: str | None = None
    role: str = "reader"

    def __post_init__(self):
        if (self.directory is None) == (self.file is None):
            raise ValueError("a rule names a directory or a file")
        p = self.directory if self.directory is not None else self.file
        if p.startswith("/") or "\\" in p or (p and any(x in ("", ".", "..") or x.startswith(".") for x in p.rstrip("/").split("/"))):
            raise ValueError(f"not a visible relative path: {p!r}")

    @property
    def target(self) -> str:
        return (self.directory if self.directory is not None else self.file).rstrip("/")


@dataclass(frozen=True)
class Policy:
    grants: tuple[Rule, ...] = ()
    denies: tuple[Rule, ...] = ()
    enabled: bool = True


_ignorable = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_control = regex.compile(r"[\\:\p{Cc}]")
# Names that stand for devices, whatever follows their first dot.
_DEVICES = frozenset(("CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in "123456789¹²³")))
#: Stands between guarded components; no valid path has it, and what a component is folded to is never split.
_BETWEEN = "\x00"


def guard(part: str) -> str:
    """What deny rules compare of a path component: compatibility-composed, case-folded, without what doesn't show."""
    folded = unicodedata.normalize("NFKC", part).casefold()
    return unicodedata.normalize("NFKC", _ignorable.sub("", folded))


def guard_path(path: str) -> str:
    return _BETWEEN.join(map(guard, path.split("/")))


def _state(path: str | None) -> tuple[str | None, str]:
    """The guarded path and what is wrong with it ("" if nothing is)."""
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") for p in parts):
        return None, "invalid_path"
    if any(p.startswith(".") or guard(p).startswith(".") for p in parts):
        return None, "reserved_path"
    if any(_control.search(p) or p.endswith((".", " ")) or p.split(".", 1)[0].upper() in _DEVICES for p in parts):
        return None, "invalid_path"
    return guard_path(path), ""


@F.pandas_udf(StructType([StructField("guarded", StringType()), StructField("fault", StringType())]))
def path_state(paths: pd.Series) -> pd.DataFrame:
    """guarded (null where there is a fault) and fault of each path; worked out for every row that a policy is asked about."""
    return pd.DataFrame([_state(p) for p in paths], columns=["guarded", "fault"])


def _covers(rule: Rule, path: Column, target: str, between: str = "/") -> Column:
    return (path == target if rule.file is not None else F.startswith(path, F.lit(target + between)) | (path == target)) if target else F.lit(True)


def decision(policy: Policy, action: str = "read", path: str = "path") -> Column:
    """(reason, rule) for a path; denies win and are compared as guarded, a reader's grant is for reading only."""
    p = F.col(path)
    state = path_state(p)
    answer = lambda reason, rule=None: F.struct(F.lit(reason).alias("reason"), F.lit(rule).cast("string").alias("rule"))
    if not policy.enabled:
        return answer("disabled")
    out = F.when(state["fault"] == "reserved_path", answer("reserved_path")).when(state["guarded"].isNull(), answer("invalid_path"))
    for r in policy.denies:
        out = out.when(_covers(r, state["guarded"], guard_path(r.target), _BETWEEN), answer("denied", r.id))
    for r in policy.grants:
        if r.role == "editor" or action == "read":
            out = out.when(_covers(r, p, r.target), answer("allowed", r.id))
    return out.otherwise(answer("no_grant"))


def readable(notes: DataFrame, policy: Policy) -> DataFrame:
    """Rows of notes that the policy lets be read."""
    return notes.where(decision(policy)["reason"] == "allowed")


def container(policy: Policy, path: str = "path") -> Column:
    """Whether a folder may be seen: it is granted, or something below it is."""
    if not policy.enabled:
        return F.lit(False)
    p, denied, seen = F.col(path), F.lit(False), F.lit(False)
    guarded = path_state(p)["guarded"]
    for r in policy.denies:
        denied |= _covers(r, guarded, guard_path(r.target), _BETWEEN)
    for r in policy.grants:
        seen |= _covers(r, p, r.target) | F.startswith(F.lit(r.target + "/"), F.concat(p, F.lit("/")))
    return guarded.isNotNull() & ~denied & seen


def visible_listing(files: DataFrame, policy: Policy) -> DataFrame:
    """Readable files and the folders that lead to what is granted, in component order."""
    from marginalia.operators.search import directories

    rows = readable(files.select("path"), policy).withColumn("kind", F.lit("file"))
    folders = directories(files).where(container(policy)).withColumn("kind", F.lit("directory"))
    return rows.unionByName(folders).orderBy(F.split("path", "/"))


_ID = re.compile(r"[A-Za-z0-9_-]{1,256}")


@dataclass(frozen=True)
class Audience:
    """A scope of path prefixes and of the properties that a note must carry."""

    prefixes: tuple[str, ...]
    properties: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 < len(self.prefixes) <= 64 or not all(p.endswith(("/", ".md")) for p in self.prefixes):
            raise ValueError("a scope has 1 to 64 prefixes that end in / or .md")


def in_audience(scope: Audience, path: str = "path", properties: str = "properties") -> Column:
    """Path under a prefix (or equal to a file) and every required property equal to its text."""
    from marginalia.functions.frontmatter import canonical

    p, ok = F.col(path), F.lit(False)
    for x in scope.prefixes:
        ok |= F.startswith(p, F.lit(x)) if x.endswith("/") else p == x
    for k, v in scope.properties.items():
        ok &= F.coalesce(F.element_at(properties, k) == canonical(v), F.lit(False))
    return ok


# The properties that name a private note's scope, the kinds of audience, and the canonical places of such notes.
SCOPE_KEYS = ("tenant_id", "star_label", "workspace_id", "audience_kind", "audience_id")
AUDIENCE_KINDS = ("channel", "dm")
CANONICAL = ("Organize/Self/{0}/", "Organize/People/{0}/", "Organize/Work/{0}/", "Organize/Topics/{0}/", "Express/Skills/{0}/", "Distill/{0}/brief.md", "Distill/{0}/index.md")
_INFERRED = re.compile(r"^\s*[-*]\s+\[inferred\s", re.M)


def private_source_eligible(path: str, content: str) -> bool:
    """Whether a private note may be indexed: valid ids in its properties, no inferred bullet, and a canonical place of its scope."""
    from marginalia.functions import frontmatter

    try:
        fm = frontmatter.parse(content) or {}
    except frontmatter.FrontmatterError:
        return False
    values = [fm.get(k) for k in SCOPE_KEYS]
    if not all(isinstance(v, str) for v in values) or values[3] not in AUDIENCE_KINDS or not all(_ID.fullmatch(v) for k, v in zip(SCOPE_KEYS, values) if k != "audience_kind"):
        return False
    scope = f"slack-{values[2].lower()}-{values[3]}-{values[4].lower()}"
    places = [p.format(scope) for p in CANONICAL]
    return path.endswith(".md") and not _INFERRED.search(content) and any(path.startswith(p) if p.endswith("/") else path == p for p in places)


def fingerprint(notes: DataFrame) -> DataFrame:
    """One hash over (path, revision) of every note, whatever order the rows come in.

    Each note is reduced to one line's hash; lines are gathered by eight, five and two digits of their path's
    hash, so a task or row holds a few thousand hashes at most until there are some 10^13 notes.
    """
    place = F.sha2("path", 256)
    line = F.sha2(F.concat(F.lpad(F.char_length("path").cast("string"), 8, "0"), "path", "revision"), 256)
    rows = notes.select(place.alias("key"), line.alias("h"), F.col("path").alias("tie"))
    gathered = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "tie", "h"))), lambda x: x["h"]), ""), 256)
    for digits in (8, 5, 2, 0):
        rows = rows.groupBy(F.substring("key", 1, digits).alias("up")).agg(gathered.alias("h")).select(F.col("up").alias("key"), F.lit("").alias("tie"), "h")
    return rows.select(F.col("h").alias("fingerprint"))
