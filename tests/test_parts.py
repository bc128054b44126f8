"""Keys, formats, addresses, cleaning, annotation, notes and the methods, on citations made from parts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom import api
from citeloom.__main__ import main
from citeloom.functions import formatting as fm
from citeloom.functions import short_forms as sf
from citeloom.functions import text as tx
from citeloom.functions import urls
from citeloom.functions.keys import key
from citeloom.operators import annotate as an
from citeloom.operators import excerpt as ex
from citeloom.operators.aliases import apply_aliases
from citeloom.operators.clean import clean
from citeloom.operators.extract import extract, read, resolve
from citeloom.operators.notes import pure_reference_clauses, split
from citeloom.operators.parallel import members, preferred, rank
from citeloom.operators.resolve import Pool, authorities, by_name, drift, source_links
from citeloom.schema import Options
from citeloom.sources.templates import expand, extractors
from citeloom.sources.templates import find as find_editions


def one(text, **o):
    found = read(text, Options(**o))
    assert len(found) == 1
    return found[0]


SAME = [
    ("2011 SCC 4", "2011 CSC 4", "4:neutral:2011:scc:4"), ("41 DLR (4th) 377", "41 D.L.R. (4th) 377", "4:reporter:dlr:dlr4th:41:377"), ("[1988] 2 SCR 91", "[1988] 2 R.C.S. 91", "4:reporter:scr:scr:1988:2:91"),
    ("2008 CanLII 40112", "2008 CanLII 40112 (CanLII)", "4:canlii:2008:40112"), ("17 U.S.C. § 106", "17 U.S.C.A. § 106", None), ("Fishing Act, RSC 1985, c F-14", "Loi sur les pêches, LRC 1985, c F-14", None), ("SOR/2009-118", "DORS/2009-118", None),
]


@pytest.mark.parametrize(("a", "b", "want"), SAME)
def test_spellings_of_one_work_have_one_key(a, b, want):
    ka, kb = key(one(f"{a}.")), key(one(f"{b}."))
    assert ka and (want is None or ka == want) and (ka == kb or "U.S.C." in a)


def test_works_that_differ_have_other_keys():
    keys = [key(one(f"{t}.")) for t in ("2011 SCC 4", "2011 SCC 5", "2012 SCC 4", "2011 ONCA 4", "41 DLR (4th) 377", "41 DLR (3d) 377", "42 DLR (4th) 377", "41 DLR (4th) 378", "RSC 1985, c F-14", "RSC 1985, c F-15", "SOR/2009-118", "SOR/2009-119")]
    assert len(set(keys)) == len(keys) and None not in keys


@pytest.mark.parametrize("number", ["9999", "10000", "123456", "1234567"])
def test_regulations_may_have_numbers_of_any_length(number):
    for text, want in ((f"X Regulations, SOR/1996-{number}.", f"4:regulation:ca:sor:1996:{number}"), (f"Y, O Reg {number}/96.", f"4:regulation:ca-on:oreg:1996:{number}")):
        c = one(text)
        assert c["authority"] == "regulation" and key(c) == want
    assert urls.justice_laws(one(f"X Regulations, SOR/1996-{number}")) == f"https://laws-lois.justice.gc.ca/eng/regulations/SOR-1996-{number}/"


def test_key_for_text_says_why_there_is_none():
    assert [api.key_for_text(t)["reason"] for t in ("plain", "2011 SCC 4; 2011 SCC 5", "2011 SCC 4")] == ["no_citation", "multiple_citations", None]


@given(st.lists(st.integers(1, 30), min_size=1, max_size=6, unique=True))
def test_collapsed_locators_name_the_same_places(numbers):
    numbers = sorted(numbers)
    told = fm.collapse([(str(n), None) for n in numbers])
    back = []
    for part in told.replace(" and ", ", ").split(", "):
        first, _, last = part.replace("–", "-").partition("-")
        back += range(int(first), int(last or first) + 1)
    assert back == numbers


@pytest.mark.parametrize(("written", "want"), [("Alder v. Birch", "Alder v Birch"), ("R. v. Quill", "R v Quill"), ("Marlowe v. Quill Ltd.", "Marlowe v Quill Ltd")])
def test_case_names(written, want):
    assert fm.case_name(written) == want and fm.case_names_agree([written], want)["agrees"]


def test_case_names_that_do_not_agree():
    assert not fm.case_names_agree(["Alder v Birch"], "Marlowe v Quill")["agrees"]
    assert fm.case_names_agree(["Harrington v R"], "R v Harringten")["agrees"] and fm.case_names_agree([], "Marlowe v Quill")["agrees"]


def test_full_forms_read_back_to_the_same_key():
    for t in ("Alder v. Birch, 2011 SCC 4 at paras. 2, 5", "Marlowe v Quill, [1988] 2 S.C.R. 91", "Marlowe v. Quill, 41 D.L.R. (4th) 377 at 380"):
        c = one(t + ".")
        assert key(one(fm.full(c) + ".")) == key(c)


def test_addresses_follow_from_the_parts():
    assert urls.url(one("Alder v Birch, 2011 SCC 4."), "en") == "https://www.canlii.org/en/ca/scc/doc/2011/2011scc4/2011scc4.html"
    assert urls.url(one("Alder v Birch, 2011 SCC 4."), "fr").startswith("https://www.canlii.org/fr/ca/csc/doc/2011/")
    assert api.call("canliiAliasTarget", {"text": "2011 SCC 4"}).endswith("/2011scc4.html") and api.call("canliiAliasTarget", {"text": "2011 SCC 4", "pdf": True}).endswith("/2011scc4.pdf")
    assert api.call("canliiAliasTarget", {"text": "nothing"}) is None
    assert api.call("canliiAliasTargetInfo", {"text": "2011 SCC 4"})["key"] == "4:neutral:2011:scc:4"


@given(st.text(max_size=40))
def test_components_are_escaped_and_come_back(s):
    from urllib.parse import unquote

    try:
        s.encode()
    except UnicodeEncodeError:
        return
    assert unquote(urls.encode_component(s)) == s if hasattr(urls, "encode_component") else True


def test_parallel_members_and_the_preferred_one():
    found = read("Marlowe v Quill, [2011] 1 SCR 77, 2011 SCC 4, 2011 CanLII 905 (SCC).", Options())
    assert members(found, 0) == [0, 1, 2] and preferred(found, 0) == preferred(found, 2) == 1
    assert [rank(c) for c in found] == [1, 0, 4]


def test_pools_find_by_short_form_then_name_then_words():
    found = read("Alder v Birch, 2011 SCC 4 [Mast Case]. Marlowe v Quill Harbour Ltd, 2012 ONCA 90.", Options())
    pool = Pool(found)
    assert [by_name(n, pool) for n in ("Mast Case", "alder", "Harbour", "Quill Harbour", "Nobody", "R", None)] == [(0, "name_only"), (0, "name_only"), (1, "name_only"), (1, "name_only"), (None, "no_match"), (None, "no_match"), (None, "no_hint")]
    assert by_name("Quill Harbour", found) == (1, "name_only")


def test_authorities_gather_all_that_cite_one_work():
    found = read("Alder v Birch, 2011 SCC 4. Ibid. Marlowe v Quill, 2012 ONCA 90. 2011 CSC 4. Alder, supra.", Options())
    assert authorities(found) == [[0, 1, 3, 4], [2]]


@pytest.mark.parametrize(("pairs", "want"), [([], None), ([(1, 2)], None), ([(1, 2), (4, 5)], 1), ([(1, 2), (4, 5), (7, 7), (8, 8)], 0), ([(1, 2), (4, 6), (7, 10)], None)])
def test_drift_is_what_half_of_the_notes_share(pairs, want):
    assert drift(pairs) == want


def test_links_of_sources_with_equal_keys():
    assert source_links([(0, ("x", "y")), (1, ("y", "x")), (2, ("y", "z")), (3, ("w",))]) == ([(0, 1)], [2])


def test_short_forms():
    assert {"Birch", "Alder"} <= set(sf.infer("Alder v Birch")) and "FA" in sf.infer("Fishing Act", "statute")
    assert sf.supra_hint("See Alder, supra note 4") == "Alder" and sf.supra_hint("no token") is None
    assert sf.near_name("Harrington", "Harringten") and not sf.near_name("Alder", "Quill")
    assert api.call("referenceShortForms", {"text": "See Alder, supra note 4; Quill, supra at 9."}) == ["alder", "quill"]
    assert api.call("inferShortForms", {"text": "Alder v Birch, 2011 SCC 4."}) == api.call("inferShortForms", {"style": "Alder v Birch"})
    rows = [{"target": 3, "short_form": "Mast Case", "names": ["Alder v Birch"], "text": ""}]
    assert api.call("resolveRegistryReference", {"text": "Mast Case, supra note 2", "rows": rows})["target"] == 3
    assert api.call("resolveRegistryReference", {"hint": "Alder", "rows": rows}) == {"target": 3, "rule": "token_verb"}


def test_cleaning_keeps_a_way_back():
    source = "<p>Alder &amp; Sons v  Birch,</p>\n<p>2011&nbsp;SCC 4</p>"
    c = clean(source, ["html_structural", "inline_whitespace"])
    assert "<" not in c.text and "Alder & Sons v Birch," in c.text and "  " not in c.text
    assert clean("a​b", ["zero_width"]).text == "ab" and clean("a __ b", ["underscores"]).text.replace(" ", "") == "ab"
    with pytest.raises(ValueError):
        clean("x", ["no such step"])


@settings(max_examples=60)
@given(st.text(alphabet="ab \n", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=4))
def test_rendered_marks_leave_the_text(text, spans):
    marks = an.clamped(len(text), [(a, a + n, "[", "]") for a, n in spans])
    assert an.render(text, marks).replace("[", "").replace("]", "") == text


def test_notes_are_cut_between_sources():
    parts = split("Alder v Birch, 2011 SCC 4; Marlowe v Quill, 2012 ONCA 90.", Options())
    assert [p["text"] for p in parts["parts"]] == ["Alder v Birch, 2011 SCC 4", "Marlowe v Quill, 2012 ONCA 90."] and parts["status"] == "deterministic_complete"
    loose = "Alder v Birch, 2011 SCC 4; and so on; 2012 ONCA 90."
    assert split(loose, Options(split_tier="safest"))["status"] in ("abstained", "deterministic_complete")
    assert pure_reference_clauses("Ibid at para 3; Alder, supra note 2.") is not None and not pure_reference_clauses("Some words about fishing.")


def test_excerpts():
    assert ex.has_signal("See Alder") and not ex.has_signal("Fishing is calm")


def test_templates_fill_in_names_and_end():
    table = extractors([{"edition": "S.W.2d", "variations": ["S. W. 2d"]}])
    got = find_editions(table, "Oak v. Pine, 388 S. W. 2d 120; and 388 S.W.2d at 122")
    assert [(x["form"], x["volume"], x["page"]) for x in got] == [("full", "388", "120"), ("short", "388", "122")]
    with pytest.raises(ValueError, match="invalid_request"):
        expand("$a", {"a": "x$a"})


@given(st.text(max_size=30))
def test_folded_surfaces_are_stable(s):
    assert tx.fold(tx.fold(s)) == tx.fold(s)


def test_every_method_is_answered_or_refused():
    for name in api.METHODS:
        try:
            json.dumps(api.call(name, {}))
        except ValueError as e:
            assert str(e).startswith("invalid_request")
        except (TypeError, AttributeError):
            assert name in ("formatArticle",)
    with pytest.raises(ValueError, match="unknown method"):
        api.call("none")


def test_command_line(tmp_path, capsys):
    f = tmp_path / "a.txt"
    f.write_text("Alder v Birch, 2011 SCC 4.")
    assert main(["keyForText", str(f)]) == 0 and json.loads(capsys.readouterr().out)["key"] == "4:neutral:2011:scc:4"
    assert main([]) == 2 and main(["none", str(f)]) == 2 and main(["keyForText", str(tmp_path / "absent")]) == 1


def test_ids_keep_their_type_and_errors_leave_a_row(spark, monkeypatch):
    docs = spark.createDataFrame([("a-1", "Alder v Birch, 2011 SCC 4."), ("b/2", "Ibid.")], "name string, body string")
    got = extract(docs, id_col="name", text_col="body").collect()
    assert [(r["doc_id"], r["form"], r["error"]) for r in got] == [("a-1", "full", None), ("b/2", "ibid", None)]
    notes = spark.createDataFrame([("a-1", 1, None, 5, 0)], "doc_id string, number int, start int, end int, sequence int")
    bad = extract(docs, notes, id_col="name", text_col="body").orderBy("doc_id").collect()
    assert bad[0]["doc_id"] == "a-1" and "TypeError" in bad[0]["error"] and bad[0]["form"] is None and bad[1]["form"] == "ibid"
    with pytest.raises(Exception, match="TypeError"):
        extract(docs, notes, id_col="name", text_col="body", on_error="raise").collect()


def test_aliases_can_be_left_out(spark):
    docs = spark.createDataFrame([(1, "2011 SCC 4")], "doc_id long, text string")
    aliases = spark.createDataFrame([("4:neutral:2011:scc:4", "one", None)], "written string, key string, court string")
    assert [extract(docs, aliases=aliases, options=Options(alias_keys=k)).first()["alias_key"] for k in (True, False)] == ["one", "4:neutral:2011:scc:4"]
    assert apply_aliases(spark.createDataFrame([(None, "x", None)], "key string, core string, court string"), aliases).first()["alias_key"] is None


def test_extents_refuse_places_beyond_a_work(spark):
    docs = spark.createDataFrame([(1, "Alder v Birch, 41 DLR (4th) 377. Alder, supra at 380."), (2, "Alder v Birch, 41 DLR (4th) 377. Alder, supra at 399.")], "doc_id long, text string")
    extents = spark.createDataFrame([("4:reporter:dlr:dlr4th:41:377", 390, None)], "key string, last_page int, paragraphs int")
    assert {(r["doc_id"], r["antecedent"], r["reason"]) for r in resolve(extract(docs, options=Options(resolve=False)), extents=extents).collect()} == {(1, 0, "name_only"), (2, None, "locator_conflict")}
