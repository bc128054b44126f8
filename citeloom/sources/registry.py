"""Reference data: courts, reporters, series of legislation, journals and jurisdictions.

The seed below states facts (names, codes, abbreviations). Larger registries are read from files of the
same columns with ``load``; every lookup takes a Registry, so that none depends on the seed.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import fold

# Id | name | jurisdiction | level | neutral codes (English, then French) | other spellings | CanLII route | French CanLII route
COURTS = """
scc|Supreme Court of Canada|ca|apex|SCC;CSC|S.C.C.;C.S.C.|ca/scc|ca/csc
fca|Federal Court of Appeal|ca|appellate|FCA;CAF||ca/fca|ca/caf
fc|Federal Court|ca|superior_trial|FC;FCT;CF;CFPI||ca/fct|ca/cf
tcc|Tax Court of Canada|ca|superior_trial|TCC;CCI||ca/tcc|
cact|Competition Tribunal|ca|tribunal|Comp Trib;Trib conc|||
cirb|Canada Industrial Relations Board|ca|tribunal|CIRB LD;CIRB||ca/cirb|
pslrb|Public Service Labour Relations Board|ca|tribunal|PSLRB;CRTFP||ca/pslrb|
pslreb|Public Service Labour Relations and Employment Board|ca|tribunal|PSLREB;FPSLREB;CRTEFP;CRTESPF||ca/pslreb|
psst|Public Service Staffing Tribunal|ca|tribunal|PSST;TDFP||ca/psst|
sst|Social Security Tribunal|ca|tribunal|SST;TSS;SSTAD;TSSDA||ca/sst|
sst-adei|Social Security Tribunal, Appeal Division, Employment Insurance|ca|tribunal|SSTADEI||ca/sst|
sst-gdis|Social Security Tribunal, General Division, Income Security|ca|tribunal|SSTGDIS||ca/sst|
psdpt|Public Servants Disclosure Protection Tribunal|ca|tribunal|PSDPT;TPFD||ca/psdpt|
tatc|Transportation Appeal Tribunal of Canada|ca|tribunal|TATCE;TATCF||ca/tatc|
oic|Office of the Information Commissioner|ca|tribunal|OIC;CI||ca/oic|
sct|Specific Claims Tribunal|ca|tribunal|SCTC;TRPC||ca/sct|
cart|Canada Agricultural Review Tribunal|ca|tribunal|CART;CRAC||ca/cart|
onca|Court of Appeal for Ontario|ca-on|appellate|ONCA|ON CA;Ont CA;CA Ont;Ont. C.A.|on/onca|
onsc|Ontario Superior Court of Justice|ca-on|superior_trial|ONSC|ON SC;Ont SCJ;Ont. S.C.J.|on/onsc|
onscdc|Ontario Divisional Court|ca-on|superior_trial|ONSCDC||on/onscdc|
oncj|Ontario Court of Justice|ca-on|trial|ONCJ||on/oncj|
hrto|Human Rights Tribunal of Ontario|ca-on|tribunal|HRTO||on/onhrt|
qcca|Court of Appeal of Quebec|ca-qc|appellate|QCCA|QC CA;CA Qué|qc/qcca|
qccs|Superior Court of Quebec|ca-qc|superior_trial|QCCS|QC CS|qc/qccs|
bcca|Court of Appeal for British Columbia|ca-bc|appellate|BCCA|BC CA|bc/bcca|
bcsc|Supreme Court of British Columbia|ca-bc|superior_trial|BCSC|BC SC|bc/bcsc|
abca|Court of Appeal of Alberta|ca-ab|appellate|ABCA|AB CA;Alta CA|ab/abca|
abqb|Court of Queen's Bench of Alberta|ca-ab|superior_trial|ABQB;ABKB|AB QB|ab/abqb|
skca|Court of Appeal for Saskatchewan|ca-sk|appellate|SKCA|SK CA|sk/skca|
mbca|Court of Appeal of Manitoba|ca-mb|appellate|MBCA|MB CA|mb/mbca|
nsca|Nova Scotia Court of Appeal|ca-ns|appellate|NSCA|NS CA|ns/nsca|
nbca|Court of Appeal of New Brunswick|ca-nb|appellate|NBCA|NB CA|nb/nbca|
nbqb|Court of Queen's Bench of New Brunswick|ca-nb|superior_trial|NBQB;NBBR||nb/nbqb|nb/NBQB
nlca|Court of Appeal of Newfoundland and Labrador|ca-nl|appellate|NLCA|NL CA|nl/nlca|
peca|Prince Edward Island Court of Appeal|ca-pe|appellate|PECA||pe/pescad|
nwtca|Court of Appeal for the Northwest Territories|ca-nt|appellate|NWTCA||nt/ntca|
ykca|Court of Appeal of Yukon|ca-yk|appellate|YKCA||yk/ykca|
ukpc|Judicial Committee of the Privy Council|uk|apex|UKPC|UKJCPC;PC||
uksc|Supreme Court of the United Kingdom|uk|apex|UKSC|||
ukhl|House of Lords|uk|apex|UKHL|HL||
ewca-civ|Court of Appeal of England and Wales (Civil Division)|uk-ew|appellate|EWCA Civ|||
ewca-crim|Court of Appeal of England and Wales (Criminal Division)|uk-ew|appellate|EWCA Crim|||
ewhc|High Court of England and Wales|uk-ew|superior_trial|EWHC|||
ewfc|Family Court of England and Wales|uk-ew|trial|EWFC|||
hca|High Court of Australia|au|apex|HCA|||
fca-au|Federal Court of Australia|au|superior_trial|FCA|||
nzsc|Supreme Court of New Zealand|nz|apex|NZSC|||
nzca|Court of Appeal of New Zealand|nz|appellate|NZCA|||
scotus|Supreme Court of the United States|us|apex||U.S.||
ca2|United States Court of Appeals for the Second Circuit|us|appellate||2d Cir.||
ca9|United States Court of Appeals for the Ninth Circuit|us|appellate||9th Cir.||
"""
# Id | kind | jurisdiction | editions | other spellings (spelling=edition) | volumes numbered by year | court | first and last year of an edition
REPORTERS = """
scr|official|ca|SCR|S.C.R.=SCR;R.C.S.=SCR;RCS=SCR|yes|scc|
fcr-ca|official|ca|FCR;FC|F.C.R.=FCR;RCF=FCR;F.C.=FC|yes||
clr-ca|specialty|ca|CLR;CLR (2d);CLR (3d);CLR (4th)|C.L.R. (2d)=CLR (2d)|no||
dlr|general|ca|DLR;DLR (2d);DLR (3d);DLR (4th)|D.L.R. (4th)=DLR (4th);D.L.R. (3d)=DLR (3d);D.L.R. (2d)=DLR (2d);D.L.R.=DLR|no||
wwr|general|ca|WWR|W.W.R.=WWR|yes||
ccc|specialty|ca|CCC;CCC (2d);CCC (3d)|C.C.C. (3d)=CCC (3d);C.C.C. (2d)=CCC (2d);C.C.C.=CCC|no||
cr|specialty|ca|CR;CR (3d);CR (4th);CR (5th);CR (6th)|C.R. (3d)=CR (3d)|no||
dtc|specialty|ca|DTC|D.T.C.=DTC|no||1920-2030
acws|digest|ca|ACWS;ACWS (3d)|A.C.W.S. (3d)=ACWS (3d)|no||
or|general|ca-on|OR;OR (2d);OR (3d)|O.R. (3d)=OR (3d);O.R. (2d)=OR (2d);O.R.=OR|no||
ac|official|uk|AC|A.C.=AC|yes||
qb|official|uk|QB|Q.B.=QB|yes||
wlr|general|uk|WLR|W.L.R.=WLR|yes||
all-er|general|uk|All ER|All E.R.=All ER|yes||
lr-hl|official|uk|LR HL|L.R. H.L.=LR HL|no||
clr-au|official|au|CLR|C.L.R.=CLR|no|hca|
fcr-au|official|au|FCR|F.C.R.=FCR|no||
us|official|us|U.S.|US=U.S.;U. S.=U.S.|no|scotus|1790-2100
s-ct|general|us|S. Ct.|S.Ct.=S. Ct.;S Ct=S. Ct.|no|scotus|
l-ed|general|us|L. Ed.;L. Ed. 2d|L.Ed.=L. Ed.;L.Ed.2d=L. Ed. 2d|no|scotus|
f|general|us|F.;F.2d;F.3d;F.4th|F. 2d=F.2d;F. 3d=F.3d;F3d=F.3d;F. 4th=F.4th;F 4th=F.4th|no||
f-supp|general|us|F. Supp.;F. Supp. 2d;F. Supp. 3d|F.Supp.=F. Supp.;F.Supp.2d=F. Supp. 2d;F.Supp.3d=F. Supp. 3d|no||
a|general|us|A.;A.2d;A.3d|A. 2d=A.2d|no||
ne|general|us|N.E.;N.E.2d;N.E.3d|N. E. 2d=N.E.2d|no||
p|general|us|P.;P.2d;P.3d|P. 2d=P.2d|no||
br|specialty|us|B.R.||no||
nj|official|us|N.J.||no||
mass|official|us|Mass.|Mass=Mass.|no||
cal|official|us|Cal.;Cal. 2d;Cal. 3d;Cal. 4th|Cal.2d=Cal. 2d|no||
se|general|us|S.E.;S.E.2d|S. E. 2d=S.E.2d|no||
sw|general|us|S.W.;S.W.2d;S.W.3d|S. W. 2d=S.W.2d|no||
nw|general|us|N.W.;N.W.2d|N. W. 2d=N.W.2d|no||
so|general|us|So.;So. 2d;So. 3d|So.2d=So. 2d;So.3d=So. 3d|no||
cal-rptr|general|us|Cal. Rptr.;Cal. Rptr. 2d;Cal. Rptr. 3d|Cal.Rptr.=Cal. Rptr.;Cal.Rptr.2d=Cal. Rptr. 2d|no||
nys|general|us|N.Y.S.;N.Y.S.2d;N.Y.S.3d|N.Y.S. 2d=N.Y.S.2d|no||
f-appx|general|us|F. App'x|Fed. App'x=F. App'x;Fed. Appx.=F. App'x|no||
frd|specialty|us|F.R.D.||no||
fed-cl|specialty|us|Fed. Cl.|Fed.Cl.=Fed. Cl.|no||
ny|official|us|N.Y.;N.Y.2d;N.Y.3d|N.Y. 2d=N.Y.2d|no||
ohio-st|official|us|Ohio St.;Ohio St. 2d;Ohio St. 3d|Ohio St.2d=Ohio St. 2d;Ohio St.3d=Ohio St. 3d|no||
ill|official|us|Ill.;Ill. 2d|Ill.2d=Ill. 2d|no||
wash|official|us|Wash.;Wash. 2d|Wash.2d=Wash. 2d;Wn.2d=Wash. 2d|no||
wis|official|us|Wis.;Wis. 2d|Wis.2d=Wis. 2d|no||
mich|official|us|Mich.||no||
minn|official|us|Minn.||no||
tex|official|us|Tex.||no||
bclr|general|ca-bc|BCLR;BCLR (2d);BCLR (3d);BCLR (4th);BCLR (5th)|B.C.L.R. (3d)=BCLR (3d);B.C.L.R. (4th)=BCLR (4th)|no||
alta-lr|general|ca-ab|Alta LR;Alta LR (2d);Alta LR (3d);Alta LR (4th)|Alta. L.R. (2d)=Alta LR (2d)|no||
sask-r|general|ca-sk|Sask R|Sask. R.=Sask R|no||
man-r|general|ca-mb|Man R;Man R (2d)|Man. R. (2d)=Man R (2d)|no||
nbr|general|ca-nb|NBR;NBR (2d)|N.B.R. (2d)=NBR (2d)|no||
nsr|general|ca-ns|NSR;NSR (2d)|N.S.R. (2d)=NSR (2d)|no||
oac|general|ca-on|OAC|O.A.C.=OAC|no||
rfl|specialty|ca|RFL;RFL (2d);RFL (3d);RFL (4th);RFL (5th)|R.F.L. (3d)=RFL (3d)|no||
cpr|specialty|ca|CPR;CPR (2d);CPR (3d);CPR (4th)|C.P.R. (3d)=CPR (3d);C.P.R. (4th)=CPR (4th)|no||
ehrr|specialty|uk|EHRR|E.H.R.R.=EHRR|no||
"""
# Id | kind | jurisdiction | abbreviation | other spellings | French spellings | CanLII jurisdiction/database | CanLII years
SERIES = """
rsc|revised_statutes|ca|RSC|R.S.C.|LRC;L.R.C.;RCS|ca/cas|
sc|annual_statutes|ca|SC|S.C.|LC;L.C.|ca/caa|
rso|revised_statutes|ca-on|RSO|R.S.O.|LRO;L.R.O.|on/ons|
so|annual_statutes|ca-on|SO|S.O.|LO;L.O.||
rsa|revised_statutes|ca-ab|RSA|R.S.A.||ab/abs|
sa|annual_statutes|ca-ab|SA|S.A.||ab/aba|
rsbc|revised_statutes|ca-bc|RSBC|R.S.B.C.||bc/bcs|
sbc|annual_statutes|ca-bc|SBC|S.B.C.||bc/bca|
rss|revised_statutes|ca-sk|RSS|R.S.S.||sk/sks|
ccsm|revised_statutes|ca-mb|CCSM|C.C.S.M.|CPLM|mb/mbs|
rsns|revised_statutes|ca-ns|RSNS|R.S.N.S.||ns/nss|
rsnb|revised_statutes|ca-nb|RSNB|R.S.N.B.|LRN-B|nb/nbs|
rsnl|revised_statutes|ca-nl|RSNL|R.S.N.L.||nl/nls|
cqlr|revised_statutes|ca-qc|CQLR|C.Q.L.R.|RLRQ;LRQ;L.R.Q.|qc/qcs|
sq|annual_statutes|ca-qc|SQ|S.Q.|LQ;L.Q.|qc/qca|
snu|annual_statutes|ca-nu|SNu|||nu/nua|
sor|regulations|ca|SOR|S.O.R.|DORS|ca/car|
si|regulations|ca|SI|S.I.|TR||
crc|regulations|ca|CRC|C.R.C.||ca/car|
oreg|regulations|ca-on|O Reg|O. Reg.;Ont Reg;Ont. Reg.|Règl de l'Ont|on/onr|two
rro|regulations|ca-on|RRO|R.R.O.|RRO|on/onr|
bcreg|regulations|ca-bc|BC Reg|B.C. Reg.||bc/bcr|four
altareg|regulations|ca-ab|Alta Reg|Alta. Reg.||ab/abr|four
nbreg|regulations|ca-nb|NB Reg|N.B. Reg.||nb/nbr|
nlr|regulations|ca-nl|NLR|||nl/nlr|two
rrs|regulations|ca-sk|RRS|R.R.S.||sk/skr|
yoic|regulations|ca-yk|YOIC|||yk/ykr|
nwtreg|regulations|ca-nt|NWT Reg|N.W.T. Reg.||nt/ntr|
nureg|regulations|ca-nu|Nu Reg|||nu/nur|
peireg|regulations|ca-pe|PEI Reg|P.E.I. Reg.||pe/per|
usc|code|us|USC|U.S.C.;U. S. C.;U.S.C.A.|||
cfr|code_regulations|us|CFR|C.F.R.|||
"""
# Id | abbreviation | other spellings | jurisdiction
JOURNALS = """
mcgill-lj|McGill LJ|McGill L.J.;RD McGill|ca
can-bar-rev|Can Bar Rev|Can. Bar Rev.|ca
queens-lj|Queen's LJ|Queen's L.J.|ca
osgoode-hall-lj|Osgoode Hall LJ|Osgoode Hall L.J.|ca
utlj|UTLJ|U.T.L.J.|ca
harv-l-rev|Harv L Rev|Harv. L. Rev.|us
yale-lj|Yale LJ|Yale L.J.|us
nyu-l-rev|NYUL Rev|N.Y.U. L. Rev.|us
minn-l-rev|Minn L Rev|Minn. L. Rev.|us
lqr|Law Q Rev|LQR|uk
"""
# Id | name
JURISDICTIONS = """
ca|Canada
ca-ab|Alberta
ca-bc|British Columbia
ca-mb|Manitoba
ca-nb|New Brunswick
ca-nl|Newfoundland and Labrador
ca-ns|Nova Scotia
ca-nt|Northwest Territories
ca-nu|Nunavut
ca-on|Ontario
ca-pe|Prince Edward Island
ca-qc|Quebec
ca-sk|Saskatchewan
ca-yk|Yukon
uk|United Kingdom
uk-ew|England and Wales
us|United States
au|Australia
nz|New Zealand
int|International
"""
#: French codes of courts.
FRENCH_CODES = frozenset("CSC CAF CF CFPI CCI CRTFP CRTEFP CRTESPF TDFP TSS TSSDA TPFD TATCF CI TRPC CRAC NBBR".split()) | {"Trib conc"}
#: Codes of courts whose decisions CanLII files under another code.
CANLII_CODE = {"CRAC": "cart"}


@dataclass
class Registry:
    courts: list[dict]
    reporters: list[dict]
    series: list[dict]
    journals: list[dict]
    jurisdictions: list[dict] = field(default_factory=list)

    def _index(self, rows: list[dict], surfaces) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = defaultdict(list)
        for r in rows:
            for s in dict.fromkeys(map(fold, surfaces(r))):
                out[s].append(r)
        return dict(out)

    @cached_property
    def by_code(self) -> dict[str, list[dict]]:
        return self._index(self.courts, lambda r: r["neutral"])

    @cached_property
    def by_court(self) -> dict[str, list[dict]]:
        return self._index(self.courts, lambda r: [*r["neutral"], *r["aliases"], r["name"]])

    @cached_property
    def by_reporter(self) -> dict[str, list[dict]]:
        return self._index(self.reporters, lambda r: [*r["editions"], *r["variations"]])

    @cached_property
    def by_series(self) -> dict[str, list[dict]]:
        return self._index(self.series, lambda r: [r["abbreviation"], *r["variations"], *r["french"]])

    @cached_property
    def by_journal(self) -> dict[str, list[dict]]:
        return self._index(self.journals, lambda r: [r["abbreviation"], *r["variations"]])

    @cached_property
    def court_ids(self) -> dict[str, dict]:
        return {r["id"]: r for r in self.courts}

    def edition(self, reporter: dict, written: str) -> str:
        """The edition of a reporter that a spelling names."""
        f = fold(written)
        for v, e in reporter["variations"].items():
            if fold(v) == f:
                return e
        return next((e for e in reporter["editions"] if fold(e) == f), written)

    def tables(self) -> dict[str, list[dict]]:
        return {"courts": self.courts, "reporters": self.reporters, "series": self.series, "journals": self.journals, "jurisdictions": self.jurisdictions}

    def lookup(self, table: str, surface: str | None = None) -> list[dict]:
        """All rows of a table, or those that a surface names."""
        if table not in self.tables():
            raise ValueError(f"invalid_request: unknown table {table!r}")
        if surface is None:
            return self.tables()[table]
        index = {"courts": self.by_court, "reporters": self.by_reporter, "series": self.by_series, "journals": self.by_journal}.get(table)
        return index.get(fold(surface), []) if index else [r for r in self.jurisdictions if fold(r["name"]) == fold(surface) or r["id"] == surface]


def _rows(table: str) -> list[list[str]]:
    return [line.split("|") for line in table.strip().splitlines()]


def _list(s: str) -> list[str]:
    return [x for x in s.split(";") if x]


def _seed() -> Registry:
    courts = [{"id": i, "name": n, "jurisdiction": j, "level": lv, "neutral": _list(c), "aliases": _list(a), "canlii": en or None, "canlii_fr": fr or None} for i, n, j, lv, c, a, en, fr in _rows(COURTS)]
    reporters = [
        {"id": i, "kind": k, "jurisdiction": j, "editions": _list(e), "variations": dict(x.split("=") for x in _list(v)), "year_volume": y == "yes", "court": c or None, "years": [int(z) for z in r.split("-")] if r else None}
        for i, k, j, e, v, y, c, r in _rows(REPORTERS)
    ]
    series = [{"id": i, "kind": k, "jurisdiction": j, "abbreviation": a, "variations": _list(v), "french": _list(f), "canlii": c or None, "canlii_year": y or None} for i, k, j, a, v, f, c, y in _rows(SERIES)]
    journals = [{"id": i, "abbreviation": a, "variations": _list(v), "jurisdiction": j} for i, a, v, j in _rows(JOURNALS)]
    return Registry(courts, reporters, series, journals, [{"id": i, "name": n} for i, n in _rows(JURISDICTIONS)])


SEED = _seed()


def load(path: str) -> Registry:
    """A registry from a JSON file with the five tables."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    return Registry(**{k: t.get(k, []) for k in ("courts", "reporters", "series", "journals", "jurisdictions")})


SURFACE_SCHEMA = "surface string, written string, id string, jurisdiction string, canonical string, kind string, rank int, year_volume boolean, first_year int, last_year int"


def surface_rows(registry: Registry, table: str) -> list[dict]:
    """A row for each spelling of each entry of a table; rank is the place among the entries of a spelling."""
    index = {"codes": registry.by_code, "courts": registry.by_court, "reporters": registry.by_reporter, "series": registry.by_series, "journals": registry.by_journal}[table]
    rows = []
    for surface, entries in sorted(index.items()):
        for rank, r in enumerate(entries):
            written = next((w for w in [*r.get("neutral", []), *r.get("aliases", []), *r.get("editions", []), *r.get("variations", []), *r.get("french", []), r.get("abbreviation", ""), r.get("name", "")] if fold(w) == surface), surface)
            canonical = registry.edition(r, written) if table == "reporters" else r.get("abbreviation") or r["id"]
            first, last = r.get("years") or [None, None]
            rows.append({"surface": surface, "written": written, "id": r["id"], "jurisdiction": r["jurisdiction"], "canonical": canonical, "kind": r.get("kind") or r.get("level"), "rank": rank, "year_volume": r.get("year_volume"), "first_year": first, "last_year": last})
    return rows


def surfaces(spark: SparkSession, table: str, registry: Registry = SEED) -> DataFrame:
    """surface_rows as a table: a dimension of fixed size (a few spellings for each entry of the registry), so that joining with it is a broadcast."""
    return spark.createDataFrame([tuple(r.values()) for r in surface_rows(registry, table)], SURFACE_SCHEMA)


def dimension(spark: SparkSession, table: str, registry: Registry = SEED) -> DataFrame:
    """A table of the registry; lists are joined by semicolons."""
    rows = [{k: json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, dict) else ";".join(map(str, v)) if isinstance(v, list) else v if v is None or isinstance(v, bool) else str(v) for k, v in r.items()} for r in registry.tables()[table]]
    names = list(rows[0]) if rows else ["id"]
    kinds = {n: "boolean" if any(isinstance(r[n], bool) for r in rows) else "string" for n in names}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
