"""Schemas of the tables that extraction gives, and the options it takes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

KEY_VERSION = "4"
SCHEMA_VERSION = 4
SPAN = "struct<start:int,end:int,text:string>"
FIELDS = (
    "struct<year:string,year_number:int,series:string,series_id:string,number:string,volume:string,reporter:string,reporter_id:string,reporter_canonical:string,page:string,bracketed:boolean,issue:string,journal_id:string,"
    "chapter:string,schedule:string,regulation:string,section:string,regnal:string,title:string,part:string,session:string,bill:string,edition:string,place:string,publisher:string,url:string,note:int>"
)
CITATION = (
    f"doc_id long, index int, form string, authority string, format string, span {SPAN}, signal {SPAN}, full_span {SPAN}, style {SPAN}, parties struct<plaintiff:string,defendant:string>, fields {FIELDS}, "
    f"court struct<id:string,text:string>, jurisdiction string, language string, pinpoints array<struct<kind:string,span:{SPAN},first:string,last:string>>, "
    f"parentheticals array<struct<kind:string,span:{SPAN},content:string>>, history array<struct<relation:string,span:{SPAN},target:int>>, short_name string, explicit_short_name string, parallel_group int, "
    "antecedent int, antecedent_reason string, key string, interpretations array<struct<kind:string,id:string,canonical:string,jurisdiction:string,selected:boolean,reason:string>>, reasons array<string>, authority_cluster int, url string"
)
SIMPLE = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def _pieces(s: str) -> list[str]:
    """A list split at commas outside angle brackets."""
    out, depth = [""], 0
    for c in s:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def type_of(s: str) -> T.DataType:
    """The type that a declaration states; needs no session."""
    if s.startswith("array<"):
        return T.ArrayType(type_of(s[6:-1]))
    if s.startswith("struct<"):
        return T.StructType([T.StructField(n, type_of(k)) for n, _, k in (x.partition(":") for x in _pieces(s[7:-1]))])
    return SIMPLE[s]


def table(s: str) -> T.StructType:
    return T.StructType([T.StructField(n, type_of(k)) for n, _, k in (x.partition(" ") for x in _pieces(s))])


FORMS = ("full", "short", "supra", "ibid", "reference", "unknown")
AUTHORITIES = ("case", "statute", "regulation", "constitution", "court_rule", "treaty", "bill", "debate", "parliamentary_paper", "journal", "book", "book_chapter", "webpage", "government_document", "unknown")
TIERS = ("safest", "safe", "moderate", "aggressive")
GUIDES = ("mcgill", "coal", "bluebook", "aglc", "oscola", "nzlsg")


@dataclass(frozen=True)
class Options:
    """What to read. Unknown names and values raise, before anything runs."""

    jurisdiction_priority: tuple[str, ...] = ("ca",)
    jurisdictions: tuple[str, ...] | None = None
    authorities: tuple[str, ...] | None = None
    forms: tuple[str, ...] | None = None
    styles: tuple[str, ...] = GUIDES
    resolve: bool = True
    parallel: bool = True
    remove_ambiguous: bool = False
    source_only: bool = False
    early_references: bool = False
    skip_authority_lists: bool = False
    ocr_repairs: bool = False
    year_runs: bool = False
    alias_keys: bool = True
    reporter_names: bool = True
    split_tier: str = "safe"
    supra_linking_mode: str = "safe"
    locators: bool = False
    latest_year: int = 2026
    language: str = "en"

    def __post_init__(self) -> None:
        for name, allowed in (("authorities", AUTHORITIES), ("forms", FORMS), ("styles", GUIDES)):
            bad = set(getattr(self, name) or ()) - set(allowed)
            if bad:
                raise ValueError(f"invalid_request: unknown {name}: {sorted(bad)}")
        if self.split_tier not in TIERS:
            raise ValueError(f"invalid_request: unknown split_tier {self.split_tier!r}")
        if self.supra_linking_mode not in ("safe", "aggressive"):
            raise ValueError(f"invalid_request: unknown supra_linking_mode {self.supra_linking_mode!r}")
        from .sources.registry import SEED

        known = {j["id"] for j in SEED.jurisdictions}
        bad = {j for j in (*self.jurisdiction_priority, *(self.jurisdictions or ())) if j not in known}
        if bad:
            raise ValueError(f"invalid_request: unknown jurisdictions: {sorted(bad)}")

    @classmethod
    def of(cls, **given) -> Options:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"invalid_request: unknown options: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
