"""One call by method name, and the same methods as SQL functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema, ship
from .functions import formatting as fm
from .functions import short_forms as sf
from .functions import urls
from .functions.keys import key
from .operators import annotate as an
from .operators import authorities as au
from .operators import excerpt as ex
from .operators import notes as nt
from .operators.clean import clean, placeholder_markup
from .operators.extents import decode
from .operators.extract import read
from .operators.find import find, has_citation, note_references
from .operators.parallel import group
from .operators.resolve import authorities, resolve_rows
from .schema import Options
from .sources.registry import SEED

OPTION_NAMES = {"jurisdictionPriority": "jurisdiction_priority", "removeAmbiguous": "remove_ambiguous", "sourceOnly": "source_only", "earlyReferences": "early_references", "skipAuthorityLists": "skip_authority_lists", "ocrRepairs": "ocr_repairs", "yearRuns": "year_runs", "aliasKeys": "alias_keys", "reporterNames": "reporter_names", "splitTier": "split_tier"}
OPTION_NAMES |= {"aliasKeys": "alias_keys", "splitTier": "split_tier", "supraLinkingMode": "supra_linking_mode"}
#: Extents of this process; tables take them as a DataFrame (operators.extract.resolve).
EXTENTS: dict[str, dict] = {}


def options(given: dict | None) -> Options:
    return Options.of(**{OPTION_NAMES.get(k, k): v for k, v in (given or {}).items() if k not in ("notes", "offsetUnit")})


def _full(text: str, o: Options) -> list[dict]:
    citations = find(text, SEED, o)
    group(text, citations)
    return [c for c in citations if c["form"] == "full"]


def key_for_text(text: str) -> dict:
    """key of the one full citation of a text, or the reason why there is none."""
    found = _full(text, Options())
    if not found:
        return {"key": None, "reason": "no_citation"}
    if len(found) > 1:
        return {"key": None, "reason": "multiple_citations"}
    k = key(found[0])
    return {"key": k, "reason": None if k else "no_identity"}


def canlii_citation_url(text: str, language: str = "en") -> str | None:
    found = _full(text, Options())
    if len(found) != 1:
        return None
    return urls.canlii_case(found[0], language) or urls.canlii_legislation(found[0], language)


def _extract(r: dict) -> dict:
    o = options(r.get("options"))
    notes = (r.get("options") or {}).get("notes") or r.get("notes")
    citations = read(r["text"], o, SEED, notes)
    return {"schemaVersion": schema.SCHEMA_VERSION, "citations": citations, "authorities": authorities(citations), "sourceParts": nt.split(r["text"], o)["parts"]}


def _resolve(r: dict) -> dict:
    citations = [{**c} for c in r["citations"]]
    if len({c["index"] for c in citations}) != len(citations):
        raise ValueError("invalid_request: indices repeat")
    notes = sorted(r.get("notes") or [], key=lambda n: n["start"])
    if any(a["end"] > b["start"] for a, b in zip(notes, notes[1:], strict=False)):
        raise ValueError("invalid_request: notes overlap")
    got = resolve_rows(citations, notes or None, SEED, EXTENTS, r.get("locators", bool(EXTENTS)), r.get("supraLinkingMode", "safe"))
    by = {c["index"]: c for c in citations}
    for x in got:
        by[x["index"]]["antecedent"] = x["antecedent"]
    return {"citations": citations, "resolutions": got, "authorities": authorities(citations)}


def _annotate(r: dict) -> dict:
    marks = [(a["start"], a["end"], a["before"], a["after"]) for a in r["annotations"]]
    if "source" not in r:
        return {"text": an.render(r["text"], marks)}
    c = clean(r["source"], r.get("cleanSteps") or [])
    if c.text != r["text"]:
        from .operators.clean import align

        c = align(r["source"], r["text"])
    return {"text": an.annotate_source(r["source"], c, marks, r.get("unbalancedTags", "unchecked"), an.clamped)}


def _register(r: dict) -> dict:
    for x in decode(r["text"].splitlines()):
        EXTENTS[x["key"]] = x
    return {"count": len(EXTENTS)}


def _split_notes(r: dict) -> list[dict]:
    return [nt.split(t, options(r.get("options"))) for t in r["texts"]]


def _hint(r: dict) -> str:
    """The name that a request gives, or that stands before supra in its text."""
    return r["hint"] if "hint" in r else sf.supra_hint(r["text"]) or ""


def _infer(r: dict) -> list[str]:
    """Short forms of a style, or of the styles of a text's full citations."""
    if "style" in r:
        return sf.infer(r["style"], r.get("kind", "case"))
    return list(dict.fromkeys(n for c in _full(r["text"], Options()) if c["style"] for n in sf.infer(c["style"]["text"], c["authority"])))


def _page(r: dict) -> str | None:
    """The page of a citation at CanLII, or its PDF."""
    page = canlii_citation_url(r["text"], r.get("language", "en"))
    return re.sub(r"\.html$", ".pdf", page) if page and r.get("pdf") else page


def _one(r: dict) -> dict:
    return r["citation"]


METHODS: dict[str, Callable[[dict], object]] = {
    "extract": _extract, "registerExtents": _register, "resolve": _resolve,
    "resolveReference": lambda r: sf.resolve_hint(r["name"], r["candidates"]),
    "inferShortForms": lambda r: _infer(r),
    "referenceShortForms": lambda r: sf.reference_forms(r["text"]),
    "referenceInfo": lambda r: sf.reference_info(r["text"]),
    "bareCitation": lambda r: nt.bare_citation(r["text"], find(r["text"], SEED, Options())),
    "legislationLookup": lambda r: urls.legislation_lookup(r["text"]),
    "stripCitationTail": lambda r: nt.strip_tail(r["text"]),
    "correctCitation": lambda r: fm.corrected_citation(_one(r)),
    "authorities": lambda r: authorities(r["citations"]),
    "captionStyleOfCause": lambda r: au.caption_style_of_cause(r["text"], r["keys"]),
    "pinpointsAt": lambda r: au.pinpoints_at(r["text"], r["start"], r["end"], r.get("strict", False)),
    "caseNamesAgree": lambda r: fm.case_names_agree(r["written"], r["other"]),
    "normalizeShortForm": lambda r: sf.normalize(r["text"]),
    "resolveInferredReference": lambda r: sf.resolve_hint(_hint(r), [{**x, "short_form": y} for x in r["rows"] for y in sf.infer(x.get("style", ""))]),
    "resolveRegistryReference": lambda r: sf.resolve_hint(_hint(r), r["rows"]),
    "reanchorReference": lambda r: sf.reanchor(r["url"], r.get("kind"), r.get("value"), r.get("form", "supra")),
    "supraHint": lambda r: sf.supra_hint(r["text"]),
    "splitSources": lambda r: nt.split(r["text"], options({"jurisdictionPriority": r["jurisdictionPriority"]} if "jurisdictionPriority" in r else None), strict=r.get("strict", False)),
    "quoteCitationUnits": _split_notes, "splitNotes": _split_notes,
    "quotedTitles": lambda r: nt.quoted_titles(r["text"]),
    "pureReferenceClauses": lambda r: nt.pure_reference_clauses(r["text"]),
    "noteReferences": lambda r: note_references(r["text"]),
    "sourceFields": lambda r: nt.fields_of(r["text"], find(r["text"], SEED, Options())),
    "key": lambda r: key(_one(r)),
    "matchesReporterHeader": lambda r: ex.matches_scr_header(r["text"]),
    "keyForText": lambda r: key_for_text(r["text"]),
    "format": lambda r: fm.format_citation(_one(r), r.get("antecedent"), r.get("note"), r.get("language", "en")),
    "formatArticle": lambda r: fm.article(**r),
    "chooseCaseCitation": lambda r: fm.choose_case_citation(r["citations"]),
    "formatDocument": lambda r: fm.document(r.get("title"), r.get("citation")),
    "caseHeading": lambda r: fm.case_name(r["style"], r.get("language", "en")),
    "pinpointLayouts": lambda r: fm.layouts(r["kind"], [tuple(p) for p in r["pins"]], r.get("language", "en")),
    "url": lambda r: urls.url(_one(r), r.get("language", "en")),
    "canliiCitationUrl": lambda r: canlii_citation_url(r["text"], r.get("language", "en")),
    "sourceAnchor": lambda r: urls.source_anchor(r["url"], r["kind"], r["locator"]),
    "sourceUrl": lambda r: urls.with_pinpoint(r["url"], _one(r)),
    "pinpointLinks": lambda r: [f"{r['url']}#{a}" if a else r["url"] for p in _one(r)["pinpoints"] for a in [urls.source_anchor(r["url"], p["kind"], p["first"])]],
    "canliiPinpointUrl": lambda r: urls.with_pinpoint(urls.canlii_case(_one(r)) or "", _one(r)) or None,
    "passageLocator": lambda r: urls.passage_locator(r["url"], r["text"]),
    "canliiPdfPage": lambda r: urls.canlii_pdf_page(r["url"], r["page"]),
    "canliiLawPage": lambda r: urls.canlii_legislation(_one(r), r.get("language", "en")),
    "sourceCanliiRoutes": lambda r: urls.canlii_routes(),
    "canliiAliasTarget": lambda r: _page(r),
    "canliiAliasTargetInfo": lambda r: {"url": _page(r), **key_for_text(r["text"])},
    "annotate": _annotate,
    "annotationRanges": lambda r: [{"start": a, "end": b} for a, b, _, _ in an.clamped(len(r["text"]), [(x["start"], x["end"], "", "") for x in r["annotations"]])],
    "clean": lambda r: {"text": clean(r["text"], r["steps"]).text},
    "placeholderMarkup": lambda r: placeholder_markup(r["text"]),
    "registry": lambda r: SEED.lookup(r["table"], r.get("surface")),
    "classifyExcerpt": lambda r: ex.classify(r["text"], Options()),
    "hasCitationCue": lambda r: ex.has_cue(r["text"]),
    "hasCitationSignal": lambda r: ex.has_signal(r["text"]),
    "isCitationContinuation": lambda r: ex.is_continuation(r["text"]),
    "protectedCitationSpans": lambda r: ex.protected_spans(r["text"], Options()),
    "hasCitation": lambda r: has_citation(r["text"], SEED, Options()),
    "version": lambda r: {"keyVersion": schema.KEY_VERSION, "schemaVersion": schema.SCHEMA_VERSION, "registry": {k: len(v) for k, v in SEED.tables().items()}},
    "warm": lambda r: find("2016 SCC 27", SEED, Options()) and True,
}


def call(method: str, request: dict | None = None) -> object:
    """The result of a method; an unknown one, or a request it can't read, is an error."""
    if method not in METHODS:
        raise ValueError(f"invalid_request: unknown method {method!r}; methods: {', '.join(METHODS)}")
    try:
        return METHODS[method](request or {})
    except KeyError as e:
        raise ValueError(f"invalid_request: {method} needs {e}") from e


#: SQL name: (method that takes a text, what its result is).
TEXT_FUNCTIONS = {
    "key_for_text": (lambda t: key_for_text(t)["key"], "string"), "key_reason": (lambda t: key_for_text(t)["reason"], "string"), "has_citation": (lambda t: has_citation(t, SEED, Options()), "boolean"),
    "case_name": (fm.case_name, "string"), "toa_sort_key": (fm.toa_sort_key, "string"), "normalize_citation": (fm.normalize_citation, "string"), "canlii_url": (canlii_citation_url, "string"), "supra_hint": (sf.supra_hint, "string"),
    "excerpt_kind": (lambda t: ex.classify(t, Options())["kind"], "string"), "clean_html": (lambda t: clean(t, ["html_structural"]).text, "string"), "reference_kind": (lambda t: sf.reference_info(t)["kind"], "string"),
    "format_text": (lambda t: next((fm.full(c) for c in _full(t, Options())), None), "string"), "heading_of": (lambda t: next((fm.heading(c["authority"]) for c in _full(t, Options())), None), "string"),
    "justice_laws_url": (lambda t: next((urls.justice_laws(c) for c in _full(t, Options())), None), "string"), "collapse_locators": (lambda t: fm.collapse([(x.strip(), None) for x in t.split(",")]), "string"),
    "section_anchor": (lambda t: urls.source_anchor("", "section", t), "string"), "supra_label": (lambda t: next((fm.supra(fm.short_label(c), 4, fm.pinpoints(c["pinpoints"])) for c in _full(t, Options())), None), "string"),
    "short_label": (lambda t: next((fm.short_label(c) for c in _full(t, Options())), None), "string"), "citation_signal": (ex.has_signal, "boolean"), "normal_short_form": (sf.normalize, "string"),
    "clause_count": (lambda t: len(nt.pure_reference_clauses(t) or []), "int"), "part_count": (lambda t: len(nt.split(t, Options())["parts"]), "int"), "citation_cue": (ex.has_cue, "boolean"),
}


def text_function(name: str):
    """A method as a function of a column, in Arrow batches."""
    import pandas as pd

    fn, kind = TEXT_FUNCTIONS[name]

    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def register(spark: SparkSession, prefix: str = "cite_") -> None:
    """All functions of a text for SQL, and ``cite_call(method, request)`` with JSON."""
    ship(spark)
    for name in TEXT_FUNCTIONS:
        spark.udf.register(prefix + name, text_function(name))
    import pandas as pd

    def run(m: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(call(a, json.loads(b or "{}")), ensure_ascii=False) for a, b in zip(m, r, strict=True)])

    run.__annotations__ = {"m": pd.Series, "r": pd.Series, "return": pd.Series}
    spark.udf.register(prefix + "call", F.pandas_udf(run, "string"))
