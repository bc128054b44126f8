"""Reading single texts: what is written is put together from parts, so that the answer is known from them."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.operators.extract import read
from citeloom.operators.find import Taken, note_references, settle, settle_named
from citeloom.schema import Options
from citeloom.sources.registry import SEED


def cite(text, **o):
    return read(text, Options(**o))


def only(text, **o):
    found = cite(text, **o)
    assert len(found) == 1, [c["full_span"]["text"] for c in found]
    return found[0]


def places(c):
    return [(p["kind"], p["first"], p["last"]) for p in c["pinpoints"]]


NAMES = ["Alder", "Birch", "Marlowe", "Quill", "Tessier", "Okafor", "Nakamura", "Vandermeer"]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(NAMES[:4]), st.sampled_from(NAMES[4:]), st.integers(2001, 2025), st.sampled_from(["SCC", "ONCA", "BCCA", "FCA"]), st.integers(1, 9999), st.lists(st.integers(1, 400), min_size=1, max_size=4, unique=True))
def test_neutral_citations_are_read_as_they_were_made(left, right, year, court, number, paragraphs):
    before, style, core = "🌲 The panel relied on precedent. See ", f"{left} v {right}", f"{year} {court} {number}"
    listed = ", ".join(map(str, paragraphs[:-1])) + (" and " if len(paragraphs) > 1 else "") + str(paragraphs[-1])
    c = only(f"{before}{style}, {core} at para{'s' if len(paragraphs) > 1 else ''} {listed}. The rest is prose.")
    assert (c["style"]["start"], c["style"]["text"], c["span"]["text"], c["signal"]["text"]) == (len(before), style, core, "see")
    assert c["full_span"]["text"].endswith(str(paragraphs[-1])) and (c["authority"], c["format"], c["court"]["id"]) == ("case", "neutral", court.lower())
    assert places(c) == [("paragraph", str(p), None) for p in paragraphs]
    assert c["parties"] == {"plaintiff": left, "defendant": right} and c["fields"]["year"] == str(year) and c["fields"]["number"] == str(number)


REPORTS = ["DLR (4th)", "CCC (3d)", "OR (3d)", "F.3d", "S.W.2d", "BCLR (4th)", "N.Y.S.2d", "Cal. Rptr. 2d", "NSR (2d)"]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_by_volume(name):
    c = only(f"Marlowe v Quill, 41 {name} 377.")
    assert (c["format"], c["fields"]["volume"], c["fields"]["reporter_canonical"], c["fields"]["page"]) == ("reporter", "41", name, "377")
    assert c["key"].endswith(":41:377")


@pytest.mark.parametrize("name", ["SCR", "AC", "QB", "WLR"])
def test_reports_by_year(name):
    c = only(f"Marlowe v Quill, [1988] 2 {name} 91.")
    assert (c["fields"]["year"], c["fields"]["volume"], c["fields"]["bracketed"]) == ("1988", "2", True) and ":1988:2:91" in c["key"]


@pytest.mark.parametrize("name", ["Cranch", "Wheat.", "Dall.", "Wall."])
def test_first_american_reports_by_their_reporters(name):
    c = only(f"Oak v. Pine, 9 U.S. (5 {name}) 212.")
    assert (c["fields"]["reporter_id"], c["fields"]["volume"], c["fields"]["page"], c["jurisdiction"]) == ("us", "9", "212", "us")


@pytest.mark.parametrize(("text", "authority", "format_", "core"), [
    ("Fishing Act, RSC 1985, c F-14, s 35.", "statute", "statute_volume", "RSC 1985, c F-14"),
    ("Harbours Act, SC 2004, c 19, s 8(1).", "statute", "statute_volume", "SC 2004, c 19"),
    ("Mooring Regulations, SOR/2009-118, s 4.", "regulation", "regulation_series", "SOR/2009-118"),
    ("Ferries, O Reg 212/07, s 3.", "regulation", "regulation_series", "O Reg 212/07"),
    ("Civil Code, CQLR c T-12, s 2.", "statute", "statute_volume", "CQLR c T-12"),
    ("See 17 U.S.C. § 106.", "statute", "code", "17 U.S.C. § 106"),
    ("See 33 C.F.R. § 164.11.", "regulation", "code", "33 C.F.R. § 164.11"),
    ("Bill C-77 was tabled.", "bill", "parliamentary", "Bill C-77"),
    ("Treaty on Lights, 88 UNTS 240.", "treaty", "treaty", "88 UNTS 240"),
    ("Okafor v Tessier, 2008 CanLII 40112 (ON SC).", "case", "can_lii", "2008 CanLII 40112"),
    ("Okafor v Tessier, 2003 CarswellOnt 812.", "case", "database", "2003 CarswellOnt 812"),
])
def test_families(text, authority, format_, core):
    c = only(text)
    assert (c["authority"], c["format"], c["span"]["text"]) == (authority, format_, core)


def test_prose_numbers_and_dates_are_no_citations():
    assert cite("On 14 March 2011 the 3 panels met; 12 of 40 agreed, 1999 to 2004, in room 7 B 21.") == []
    assert cite("") == [] and cite("nothing at all") == []


@pytest.mark.parametrize(("tail", "want"), [
    (" at para 12", [("paragraph", "12", None)]), (" at paras 12-15", [("paragraph", "12", "15")]), (" at paras 3, 9–11 and 20", [("paragraph", "3", None), ("paragraph", "9", "11"), ("paragraph", "20", None)]),
    (" at 44", [("page", "44", None)]), (" at pp 191-93", [("page", "191", "193")]), (", s 7(2)-(4)", [("section", "7(2)", "7(4)")]), (" au para 8", [("paragraph", "8", None)]),
])
def test_pinpoints(tail, want):
    assert places(only(f"Nakamura v Vandermeer, 2014 BCCA 310{tail}.")) == want


def test_a_pinpoint_ends_before_the_next_citation():
    a, b = cite("Alder v Birch, 2011 SCC 4 at paras 2, 5, 2012 ONCA 90.")
    assert places(a) == [("paragraph", "2", None), ("paragraph", "5", None)] and b["span"]["text"] == "2012 ONCA 90"


def test_parentheticals_and_courts():
    c = only("Oak v. Pine, 410 F.2d 120 (2d Cir. 1969) (holding that a mast is a spar).")
    assert [p["kind"] for p in c["parentheticals"]] == ["court", "explanatory"] and (c["court"]["id"], c["fields"]["year"]) == ("ca2", "1969")


def test_history_names_its_target():
    a, b = cite("Alder v Birch, 2009 ONCA 15, aff'd 2011 SCC 4.")
    assert [(h["relation"], h["target"]) for h in a["history"]] == [("affirmed", b["index"])]


def test_parallel_citations_share_what_one_knows():
    found = cite("Marlowe v Quill, 2011 SCC 4, [2011] 1 SCR 77, 2011 CanLII 905 (SCC).")
    assert [c["parallel_group"] for c in found] == [0, 0, 0] and {c["style"]["text"] for c in found} == {"Marlowe v Quill"} and {c["court"]["id"] for c in found} == {"scc"}
    assert [c["parallel_group"] for c in cite("Marlowe v Quill, 2011 SCC 4, 2012 SCC 9.")] == [None, None]


def test_back_references_follow_the_last_authority():
    text = "Alder v Birch, 2011 SCC 4 [Alder]. Ibid at para 3. Marlowe v Quill, 2012 ONCA 90. Alder, supra at para 8. Ibid."
    assert [(c["form"], c["antecedent"]) for c in cite(text)] == [("full", None), ("ibid", 0), ("full", None), ("supra", 0), ("ibid", 0)]


def test_a_name_that_two_decisions_share_is_in_doubt():
    text = "Alder v Birch, 2011 SCC 4. Alder v Quill, 2012 ONCA 90. Alder, supra at para 8."
    c = cite(text)[-1]
    assert (c["form"], c["antecedent"], c["antecedent_reason"]) == ("supra", None, "ambiguous_name")


def test_names_with_a_pinpoint_refer_back():
    found = cite("Vandermeer v Okafor, 2011 SCC 4. As Vandermeer at para 9 says, Okafor came late. Vandermeers at para 3 is another word.")
    assert [(c["form"], c["span"]["text"], c["antecedent"]) for c in found] == [("full", "2011 SCC 4", None), ("reference", "Vandermeer", 0)]
    early = cite("Vandermeer at para 9 came first. Vandermeer v Okafor, 2011 SCC 4.", early_references=True)
    assert [c["form"] for c in early][0] == "reference"


def test_notes_and_their_numbers():
    one, two = "Alder v Birch, 2011 SCC 4.", "Marlowe v Quill, 2012 ONCA 90; Tessier c Lavigne, 2013 QCCA 5."
    three, four = "Supra note 1 at para 2.", "Tessier, supra note 2."
    notes, text = [], ""
    for i, t in enumerate((one, two, three, four, "Supra note 2.", "Supra note 9."), 1):
        notes.append({"number": i, "start": len(text), "end": len(text) + len(t), "sequence": 0})
        text += t + "\n"
    got = [(c["antecedent"], c["antecedent_reason"]) for c in read(text, Options(), notes=notes) if c["form"] == "supra"]
    assert got == [(0, "note_only"), (2, "note_and_name"), (None, "ambiguous_note"), (None, "note_out_of_range")]


def test_bold_linking():
    text = "Harrington v Moskalik, 2011 SCC 4. Harringten, supra at para 3."
    assert cite(text)[-1]["antecedent"] is None and cite(text, supra_linking_mode="aggressive")[-1]["antecedent_reason"] == "near_name"
    parts = ["Alder v Birch, 2011 SCC 4.", "Marlowe v Quill, 2012 ONCA 90.", "Okafor v Tessier, 2013 BCCA 5.", "Marlowe, supra note 1.", "Okafor, supra note 2.", "Supra note 0 at para 4."]
    notes, at = [], 0
    for i, t in enumerate(parts, 1):
        notes.append({"number": i, "start": at, "end": at + len(t), "sequence": 0})
        at += len(t) + 1
    got = [(c["antecedent"], c["antecedent_reason"]) for c in read("\n".join(parts), Options(supra_linking_mode="aggressive"), notes=notes) if c["form"] == "supra"]
    assert got == [(1, "name_over_note"), (2, "name_over_note"), (0, "renumbered")]


def test_id_before_the_first_page_is_refused():
    for page, want in ((119, None), (120, 0), (131, 0)):
        assert cite(f"Oak v. Pine, 410 F.2d 120 (2d Cir. 1969). Id. at {page}.")[-1]["antecedent"] == want


def test_courts_that_share_a_code_are_told_by_brackets():
    assert [only(t)["jurisdiction"] for t in ("Alder v Birch, 2011 FCA 4.", "Alder v Birch [2011] FCA 4.")] == ["ca", "au"]


def test_options():
    text = "Alder v Birch, 2011 SCC 4. Fishing Act, RSC 1985, c F-14. Alder, supra."
    assert [c["form"] for c in cite(text, forms=("full",))] == ["full", "full"]
    assert [c["authority"] for c in cite(text, authorities=("statute",)) if c["form"] == "full"] == ["statute"]
    assert all(c["antecedent"] is None for c in cite(text, resolve=False))
    for bad in ({"split_tier": "x"}, {"authorities": ("x",)}, {"jurisdictions": ("xx",)}, {"supra_linking_mode": "x"}):
        with pytest.raises(ValueError, match="invalid_request"):
            Options(**bad)
    with pytest.raises(ValueError, match="unknown options"):
        Options.of(nothing=1)


PIECES = ["Alder v Birch, 2011 SCC 4 at para 9", "Ibid", "Marlowe v Quill, [1988] 2 SCR 91", "Alder, supra note 3", "41 DLR (4th) 377", "§ 12", "RSC 1985, c F-14", "(see above)", "“quoted”", "plain words", "🌲", "Bill C-7", "\n\n", "https://a.example/x", "Quill at para 3"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.sampled_from([". ", "; ", ", ", " "]))
def test_extents_are_true_ordered_and_apart(pieces, joint):
    text, at = joint.join(pieces), 0
    for i, c in enumerate(cite(text)):
        full, core = c["full_span"], c["span"]
        assert c["index"] == i and full["start"] >= at and full["start"] <= core["start"] < core["end"] <= len(text)
        assert text[full["start"] : full["end"]] == full["text"] and text[core["start"] : core["end"]] == core["text"]
        assert c["antecedent"] is None or c["antecedent"] < i
        at = full["end"]


def test_time_is_in_proportion_to_the_text():
    def made(n):
        return " ".join(f"In Marlowe{i} v Quill{i}, 20{i % 20 + 2:02d} SCC {i + 1} at para 3, it was held. Marlowe{i}, supra at para 3; ibid. Quill{i} at para 9 and 41 DLR (4th) {i + 1}." for i in range(n))

    cite(made(20))
    took = []
    for n in (300, 1200):
        began = time.perf_counter()
        assert len(cite(made(n))) == 5 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_note_references():
    text = "Doe, supra note 14; see infra n 3; note 8 ci-dessus; see also footnote 21"
    assert [(r["note"], r["direction"]) for r in note_references(text)] == [(14, "back"), (3, "forward"), (8, "back"), (21, "unspecified")]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)).map(lambda x: (x[0], x[0] + x[1])), max_size=20))
def test_overlaps_are_settled_from_the_left(hits):
    kept = sorted(hits[i] for i in settle(hits))
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
    assert all(h in kept or any(k[0] < h[1] and h[0] < k[1] for k in kept) for h in hits)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=20), st.integers(0, 70), st.integers(1, 9))
def test_extents_answer_like_a_walk_over_all(spans, at, n):
    cs = [{"full_span": {"start": a, "end": a + k}} for a, k in spans]
    t = Taken(cs)
    assert t.overlaps(at, at + n) == any(a < at + n and at < a + k for a, k in spans)
    assert t.end_before(at) == max([0, *(a + k for a, k in spans if a + k <= at)]) and t.start_from(at, 99) == min([99, *(a for a, _ in spans if a >= at)])


def test_longer_names_win():
    assert settle_named([(0, 5, "Alder"), (0, 11, "Alder Court"), (20, 24, "Elms")]) == [1, 2]


def test_random_bytes_of_text_do_no_harm():
    r = random.Random(3)
    for _ in range(150):
        cite("".join(r.choice("[](){}.,;:§“” v c R2011SCCat para nte\n’'&-") for _ in range(r.randint(0, 200))))


def test_families_are_chosen_once_for_all_texts(monkeypatch):
    from citeloom.operators import find as fi

    calls, chosen = [], fi.chosen
    monkeypatch.setattr(fi, "_CHOSEN", {})
    monkeypatch.setattr(fi, "chosen", lambda *a: calls.append(a) or chosen(*a))
    for o in (Options(), Options(authorities=("case",)), Options(styles=("oscola",))):
        for i in range(5):
            fi.anchors(f"2016 SCC {i}; 17 U.S.C. § 106", SEED, o)
    assert len(calls) == 3


def test_every_name_of_the_registry_may_begin_a_core():
    """The sets of first characters leave out no name."""
    from citeloom.operators import grammar as gr

    by = dict(gr.families(SEED))
    for r in SEED.series:
        for name in (r["abbreviation"], *r["variations"], *r["french"]):
            family, text = ("regulation", f"{name}/2001-12") if r["kind"] == "regulations" else ("statute", f"{name} 2001, c 7")
            if r["kind"] == "regulations" or "statutes" in r["kind"]:
                assert by[family].search(text), name
    for r in SEED.reporters:
        for name in (*r["editions"], *r["variations"]):
            assert by["reporter"].search(f"12 {name} 34") and by["reporter"].search(f"[2001] {name} 34"), name


PIECES = ["Ibid", "ibid.", "IBID", "Id. at 5", "id., ", "supra", "Supra note 3", "above n 4", "(n 5)", "(n x)", "précitée, note 2", "op cit", "op. cit. note 9", "Alder", "Alder's", "Alder2", "of the", " ", ", ", ". ", "; ", "| ", "\n", "“", "R v", "(", ")", "1999", "[2001]", "2001 SCC 5", "12001 SCC 5", "2003 CanLII 50", "[2003] OJ No 55", "2001 SCC at para 4", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.integers(0, 20), st.integers(0, 80))
def test_quick_looks_miss_nothing(pieces, start, end):
    """What is tried only where a first look finds something is what the whole pattern finds everywhere."""
    from citeloom.operators import find as fi
    from citeloom.operators import grammar as gr

    text = "".join(pieces)
    spans = lambda ms: [(m.span(), m.groups()) for m in ms]
    assert spans(gr.backs(text)) == spans(gr.BACK.finditer(text)) and spans(gr.backs(text, start, end)) == spans(gr.BACK.finditer(text, start, end))
    assert spans(filter(None, [gr.name_before(text)])) == spans(filter(None, [gr.NAME_BEFORE.search(text)]))
    years = [m.start() for m in gr.YEAR_AT.finditer(text)]
    for family, pattern in gr.families(SEED):
        if family in gr.BY_YEAR:
            assert spans(fi.matches_at(pattern, text, years)) == spans(pattern.finditer(text)), family
    for words in (["Alder", "of", "R"], [f"w{i}" for i in range(20)] + ["Alder", "of", "R"]):
        assert list(fi.places(text, words)) == [(m.start(), m[0]) for m in fi.WORD.finditer(text) if m[0] in words]


def test_every_name_of_the_registry_is_looked_for():
    """The words that names begin with leave out no report and no journal."""
    from citeloom.operators import grammar as gr

    begun = gr.beginnings(SEED)
    assert set(begun) == {"reporter", "short", "journal"}
    for family, rows, kinds in (("reporter", SEED.reporters, ("editions", "variations")), ("journal", SEED.journals, ("variations",))):
        for name in gr.spellings([x for r in rows for k in kinds for x in r[k]]):
            for text in (f"12 {name} 34", f"[2001] {name} 34", f"({name} 34"):
                assert not set(gr.WORD.findall(text)).isdisjoint(begun[family]), text
