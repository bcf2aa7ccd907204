"""Parsing of a made-up guide, its chunks, search over them, and ingestion."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import cards, chunks, evaluation, policies, search
from scriptorium.operators import questions as Q
from scriptorium.sources import ingest

LINES = "document string, page int, printed string, width double, height double, n int, text string, x0 double, top double, x1 double, bottom double, size double"
TABLES = "document string, page int, printed string, n int, top double, rows array<array<string>>"


def page(number, printed, *texts):
    """Lines (text, top, x0, size) of one page."""
    return [("g", number, printed, 600.0, 800.0, i, t, x0, float(top), x0 + 200, top + 8.0, size) for i, (t, top, x0, size) in enumerate((*t, 40.0, 10.0)[:4] if len(t) < 3 else (*t, 10.0)[:4] for t in texts)]


COURSE_PAGES = [
    *page(53, "A.1", ("Faculty of Science", 700)),
    *page(
        54, "B.1",
        ("Example Guide", 10),
        ("Course of Study", 100), (": M.Sc. Physics", 102, 200.0), ("Self Financing Scheme", 115, 200.0),
        ("Qualifying", 140), ("B.Sc. with 50 %", 141, 200.0), ("Examination and more", 150, 40.0),
        ("Age Limit: none", 170),
        ("Faculty of Arts", 300),
        ("Course of Study: M.A. History", 320), ("Selection Process: test", 340), ("Process by merit", 350, 40.0), ("then interview", 360, 200.0),
        ("B.1", 790),
    ),
    *page(55, "B.2", ("continued on merit", 60, 200.0), ("Remarks: twice a year", 80), ("NEW PART", 200, 40.0, 14.0), ("Age Limit: lost", 220)),
    *page(56, "B.3", ("The Course of Study is narrative", 60, 20.0), ("Course of Study: nothing follows", 500)),
    *page(60, "C.1", ("Age Limit: not merged", 60), ("Course of Study: Ph.D. Law", 300), ("Remarks: none", 320)),
]
COURSE_TABLES = [
    ("g", 54, "B.1", 0, 200.0, [["Duration", "Course Code", "Intake", None], [None, None, "Male", "Female"], ["2 years", "PH-1", "10", "5"], [None, "PH-1", "", None], ["", "", None, ""], [None, None, "12", None]]),
    ("g", 54, "B.1", 1, 330.0, [["only", "unknown"], ["x", "y"]]),
    ("g", 54, "B.1", 2, 345.0, [["Course of Study", ":", "M.A. History and Culture"], ["Code", "Faculty"], ["HI-1", None]]),
]


@pytest.fixture(scope="module")
def guide(spark):
    lines = spark.createDataFrame(COURSE_PAGES, LINES).repartition(3)
    tables = spark.createDataFrame(COURSE_TABLES, TABLES)
    return lines, tables


def test_course_cards(spark, guide):
    rows = {r.course_name: r for r in cards.courses(*guide, headers=("example guide",)).collect()}
    assert set(rows) == {"M.Sc. Physics Self Financing Scheme", "M.A. History and Culture", "Ph.D. Law"}
    physics, history, law = (rows[k] for k in ("M.Sc. Physics Self Financing Scheme", "M.A. History and Culture", "Ph.D. Law"))
    assert physics.record_id == "g:54:1:m-sc-physics-self-financing-scheme" and history.record_id.startswith("g:54:2:m-a-history")
    assert [r.faculty for r in (physics, history, law)] == ["Faculty of Science", "Faculty of Arts", "Faculty of Arts"]
    assert [r.program_level for r in (physics, history, law)] == ["postgraduate", "postgraduate", "research"]
    assert [(f.name, f.value) for f in physics.fields] == [("qualifying_examination", "B.Sc. with 50 % and more"), ("age_limit", "none")]
    assert physics.fields[0].box.top == 141.0 and physics.fields[0].box.bottom == 158.0
    assert [(f.name, f.value) for f in history.fields] == [("selection_process", "test by merit then interview continued on merit"), ("remarks", "twice a year")]
    assert history.fields[0].box is None and history.fields[1].box is not None
    assert [(f.name, f.value) for f in law.fields] == [("remarks", "none")]
    (t,) = physics.tables
    assert t.headers == ["duration", "course_code", "intake_male", "intake_female"]
    got = [[(c.key, c.text, c.inherited) for c in row] for row in t.rows]
    assert got == [
        [("duration", "2 years", False), ("course_code", "PH-1", False), ("intake_male", "10", False), ("intake_female", "5", False)],
        [("duration", "2 years", True), ("course_code", "PH-1", False), ("intake_male", "10", True), ("intake_female", "5", True)],
        [("duration", "2 years", True), ("intake_male", "12", False), ("intake_female", "5", True)],
    ]
    assert physics.course_code == "PH-1" and history.course_code == "HI-1" and law.course_code is None
    assert {r.faculty for r in cards.courses(*[d.where("page = 54") for d in guide], initial_faculty="Faculty X").collect()} == {"Faculty X", "Faculty of Arts"}
    assert cards.courses(*[d.limit(0) for d in guide]).collect() == []


def test_policy_sections(spark):
    long = [(" ".join(f"w{i}_{j}" for j in range(30)), 100 + 10 * i) for i in range(5)]
    rows = [
        *page(19, "19", ("Example Guide", 10), ("RULES FOR ALL", 40, 40.0, 14.0), ("First   rule.", 60), ("Documents needed:", 70), *long, ("19", 780)),
        *page(20, "20", ("still the same", 50), ("CALENDAR", 90, 40.0, 10.0), ("1. Dates follow", 100)),
        *page(60, "60", ("not policy", 50)),
    ]
    got = sorted(policies.sections(spark.createDataFrame(rows, LINES).repartition(2), limit=60, headers=("example guide",)).collect(), key=lambda r: (r.page, r.record_id))
    assert [(r.page, r.heading, r.heading_path) for r in got] == [
        (19, "RULES FOR ALL", []),
        *[(19, "Documents needed", ["RULES FOR ALL"])] * 3,
        (20, "Documents needed", ["RULES FOR ALL"]),
        (20, "CALENDAR", ["RULES FOR ALL"]),
    ]
    assert [r.record_id for r in got][:2] == ["g:policy:19:1:rules-for-all", "g:policy:19:2:documents-needed"] and got[0].text == "First rule."
    assert [len(r.text.split()) for r in got[1:4]] == [60, 60, 30] and got[1].text.count("\n") == 1
    with pytest.raises(ValueError):
        policies.sections(spark.createDataFrame(rows, LINES), limit=10)


APPENDIX = [
    ("g", 130, "130", 0, 50.0, [["x"]]),
    ("g", 130, "130", 1, 90.0, [
        ["S.No.", "Name of Course"], ["UNDERGRADUATE PROGRAMMES"], ["Faculty of Arts"],
        ["1.", "B.A. (Hons.)", "AB-1", "Rs. 300", "1 May", "20 May", "30 May", "Dean"], ["2", "C ertificate in Law"],
        ["3.", "B.Voc.", "VO1", "See the website", "Office"], ["4.", "Other", "Rs. 500", "Will be notified later", "Unit"],
        ["POSTGRADUATE COURSES"], ["5.", "M.A."],
    ]),
    ("g", 150, "150", 0, 50.0, [
        ["1.", "B.Tech.", "T", "10 June", "2 hours", "10 am"], ["Paper II", "4 pm"], ["2.", "B.Arch."], ["Paper III"], ["3.", "Dip."], ["a", "b", "c", "d"],
        ["4.", "MBA", "D", "By interview"], ["5.", "LLM", "N"],
    ]),
    ("g", 151, "151", 0, 50.0, [["6.", "LLB"]]),
    ("g", 173, "173", 0, 50.0, [["1.", "B.A.", "(Hons.)", "Rs. 900"], ["2.", "alone"]]),
]


def test_appendix_rows(spark):
    got = {(r.appendix_type, r.serial_number): r for r in policies.appendix_rows(spark.createDataFrame(APPENDIX, TABLES).repartition(2)).collect()}
    values = lambda kind, n: [(v.key, v.text, v.inherited) for v in got[kind, n]["values"]]
    dated = [("processing_charges", "Rs. 300"), ("form_opening_date", "1 May"), ("closing_without_late_fee", "20 May"), ("closing_with_late_fee", "30 May"), ("form_handling_office", "Dean")]
    a, t, f = "application_summary", "test_schedule", "fee_summary"
    assert values(a, "1") == [(*x, False) for x in dated] and values(a, "2") == [(*x, True) for x in dated]
    assert values(a, "3") == [("application_form_details", "See the website", False), ("form_handling_office", "Office", False)]
    assert values(a, "4")[1:] == [("application_form_details", "Will be notified later", False), ("form_handling_office", "Unit", False)]
    assert [(got[a, n].programme_group, got[a, n].faculty) for n in ("1", "4", "5")] == [("UNDERGRADUATE PROGRAMMES", "Faculty of Arts")] * 2 + [("POSTGRADUATE COURSES", None)]
    assert (got[a, "1"].course_code, got[a, "2"].course_name, got[a, "1"].record_id) == ("AB-1", "Certificate in Law", "g:application_summary:130:4:1:b-a-hons")
    assert values(t, "1") == [("date_or_method", "10 June", False), ("duration", "2 hours | Paper II", False), ("scheduled_start", "10 am | 4 pm", False)]
    assert values(t, "2") == [("date_or_method", "10 June", True), ("duration", "2 hours | Paper II | Paper III", True), ("scheduled_start", "10 am | 4 pm", True)]
    assert values(t, "3") == values(t, "2")
    assert values(t, "4") == [("date_or_method", "By interview", False)] and values(t, "6") == [("date_or_method", "By interview", True)]
    assert [got[t, str(n)].category for n in range(1, 7)] == ["T", "T", "T", "D", "N", "D"]
    assert (got[f, "1"].course_name, values(f, "1")) == ("B.A. (Hons.)", [("fee_at_admission", "Rs. 900", False)]) and (f, "2") not in got


def test_ingestion_publishes_all_or_nothing_and_skips_equal_inputs(spark, guide, tmp_path):
    lines, tables = guide
    lines = lines.union(spark.createDataFrame(page(20, "20", ("RULES", 40, 40.0, 14.0), ("Bring papers.", 60)), LINES))
    tables = tables.union(spark.createDataFrame(APPENDIX, TABLES))
    store = str(tmp_path / "store")
    decided = lambda *rows: spark.createDataFrame(rows, "record_id string, status string")
    with pytest.raises(ValueError, match="no document"):
        ingest.default_document(spark, store)
    with pytest.raises(ValueError, match="unknown records"):
        ingest.ingest(store, "g", lines, tables, decided(("nobody", "approved")))
    assert ingest.runs(spark, store).count() == 0
    physics = "g:54:1:m-sc-physics-self-financing-scheme"
    first = ingest.ingest(store, "g", lines, tables, decided((physics, "approved"), ("g:policy:20:1:rules", "approved"), ("g:fee_summary:173:1:1:b-a-hons", "rejected")))
    assert (first.skipped, first.n_chunks) == (False, 2)
    again = decided(("g:policy:20:1:rules", "approved"), ("g:fee_summary:173:1:1:b-a-hons", "rejected"), (physics, "approved"))
    assert ingest.ingest(store, "g", lines.repartition(5), tables, again) == ingest.Result(True, first.fingerprint)
    third = ingest.ingest(store, "g", lines, tables, decided((physics, "approved")))
    assert (third.skipped, third.n_chunks) == (False, 1) and third.fingerprint != first.fingerprint
    (chunk,) = ingest.load(spark, store, "chunks").collect()
    assert chunk.text == (
        "Course: M.Sc. Physics Self Financing Scheme\nExpanded Course Name: Master of Science\nCourse Code: PH-1\nFaculty: Faculty not resolved\n"
        "Programme Level: postgraduate\nRecord Type: Course Profile\n\nQualifying Examination: B.Sc. with 50 % and more\n\nAge Limit: none\n\nCourse Details:\n"
        "Row 1: Duration=2 years; Course Code=PH-1; Intake Male=10; Intake Female=5\nRow 2: Duration=2 years; Course Code=PH-1; Intake Male=10; Intake Female=5\n"
        "Row 3: Duration=2 years; Intake Male=12; Intake Female=5\n\nSource Pages: Guide, page B.1 (physical page 54)"
    )
    assert chunk.metadata["program_level"] == "postgraduate" and "campus" not in chunk.metadata
    preview = chunks.build(*[ingest.load(spark, store, t, "g") for t in ("courses", "sections", "appendix_rows")], decided((physics, "rejected")), preview=True)
    assert {r.chunk_type for r in preview.collect()} == {"course_overview", "policy_section", "appendix_row"} and preview.where(F.col("parent_record_id") == physics).count() == 0
    with pytest.raises(ValueError, match="not approved"):
        chunks.approved_only(preview)
    with pytest.raises(ValueError, match="different documents"):
        chunks.build(ingest.load(spark, store, "courses"), ingest.load(spark, store, "sections").limit(0), ingest.load(spark, store, "appendix_rows"), decided())


PASSAGES = [
    ("p1", "M.Sc. Physics", "Course: Master of Science in Physics\nCode: PH 201\nAge Limit: 25 years", "course_overview", None, "c1"),
    ("p2", "B.Sc. Physics", "Course: Bachelor of Science in Physics\nSeats: 40", "course_overview", None, "c2"),
    ("p3", "Fees", "Course: Master of Science in Physics\nFee At Admission: Rs. 900", "appendix_row", "fee_summary", "a1"),
    ("p4", "Rules", "Bring all documents to the admission office", "policy_section", None, "s1"),
]
COURSES = [("c1", "Master of Science in Physics", "postgraduate"), ("c2", "Bachelor of Science in Physics", "undergraduate")]
ASKED = [(1, "fee of the M.Sc. in Physics"), (2, "I have a bachelor degree, which courses can I take in physics?"), (3, "is PH-201 the code"), (4, "documents for admission")]


def test_search_discovery_and_answers(spark, tmp_path):
    passages = spark.createDataFrame(PASSAGES, "id string, title string, text string, type string, field_name string, parent string")
    courses = spark.createDataFrame(COURSES, "parent string, course_name string, program_level string")
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    analysed = search.analyse(asked, courses).cache()
    got = {r.query_id: r for r in analysed.collect()}
    assert got[1].expanded == "fee of the Master of Science in Physics" and got[1].preferred == ["fee_summary"]
    assert got[1].names == ["master of science", "master of science in physics"] and got[2].levels == ["postgraduate"] and got[2].discovery and not got[1].discovery
    with pytest.raises(ValueError):
        search.analyse(spark.createDataFrame([(1, "  ")], "query_id long, text string"), courses)
    hits = search.search(passages, analysed, 5).collect()
    best = {r.query_id: r for r in hits if r.place == 1}
    one = 1 / 61
    assert best[1].id == "p3" and abs(best[1].intent_boost - 1.25 * one) < 1e-12 and abs(best[1].name_boost - 1.5 * one) < 1e-12
    assert best[3].id == "p1" and abs(best[3].exact_boost - 0.5 * one) < 1e-12 and best[4].id == "p4"
    for r in hits:
        fused = sum(1 / (60 + k) for k in (r.lrank, r.vrank) if k)
        assert abs(r.score - fused - r.intent_boost - r.exact_boost - r.name_boost) < 1e-9
    found = {(r.query_id, r.place): r for r in search.discover(passages, analysed, courses).collect()}
    assert found[2, 1].parent == "c1" and abs(found[2, 1].level_boost - 0.5 * one) < 1e-12
    with pytest.raises(ValueError):
        search.search(passages, analysed, 0)

    generate = lambda q, c: F.when(F.contains(q, F.lit("bachelor")), "You are eligible.").when(F.contains(q, F.lit("fee")), "Rs. 900 [SOURCE 1]").otherwise("See [SOURCE 9]")
    repair = lambda q, c, a, why: F.when(F.lit(why == "claims"), "Perhaps. [SOURCE 1]").otherwise(a)
    out = {r.query_id: r for r in search.ask(passages, courses, asked, generate, repair).collect()}
    assert out[1]["mode"] == "hybrid_retrieval" and out[1].sources[0] == "p3" and out[1].valid == [1] and out[1].warning is None
    assert out[1].context.startswith("[SOURCE 1]\nTitle: Fees\nEvidence type: Guide appendix record\nContent:\nCourse: Master")
    assert out[2]["mode"] == "course_discovery" and out[2].claims_repaired and out[2].answer == "Perhaps. [SOURCE 1]" and out[2].warning is None
    assert out[4].citations_repaired and out[4].invalid == [9] and "not there: 9" in out[4].warning
    assert all(len(set(r.sources)) == len(r.sources) for r in out.values())
    with pytest.raises(ValueError):
        search.ask(passages, courses, asked, generate, policy_limit=-1)

    (tmp_path / "cases.json").write_text(json.dumps([{"query": ASKED[0][1], "expected_parent_record_id": "a1", "expected_field": "fee_summary"}, {"query": ASKED[2][1], "expected_parent_record_id": "c1", "expected_field": "age_limit"}, {"query": ASKED[3][1], "expected_parent_record_id": "c2", "expected_field": None, "expected_max_rank": 1}]))
    cases = evaluation.cases(spark, str(tmp_path / "cases.json"))
    ranked = search.search(passages, search.analyse(cases.select("query_id", "text"), courses))
    results = evaluation.judged(cases, ranked, passages)
    assert {r.text: r.success for r in results.collect()} == {ASKED[0][1]: True, ASKED[2][1]: True, ASKED[3][1]: False}
    evaluation.write_report(results, str(tmp_path / "report"))
    (line,) = spark.read.json(str(tmp_path / "report" / "summary")).collect()
    assert (line.total, line.passed, line.accuracy, line.line) == (3, 2, 0.666667, "2/3 (66.7%)")


def test_spans_titles_and_uncovered_abbreviations(spark):
    df = spark.createDataFrame([("PGDCP and P.G. Diploma, b.tech. x", "M.Sc. Physics (old MA style)", "M.Sc. (ABC) with G.H.Q. and GIS")], "q string, t string, u string")
    r = df.select(Q.alias_spans(F.col("q")).alias("s"), Q.title_names(F.col("t")).alias("t"), Q.uncovered_abbreviations(F.col("u")).alias("u")).first()
    assert [(x.start, x.end, x.abbreviation, x.text) for x in r.s] == [(0, 5, "PGDCP", "PGDCP"), (10, 22, "PGD", "P.G. Diploma"), (24, 31, "BTECH", "b.tech.")]
    assert r.s[2].full_name == "Bachelor of Technology"
    assert r.t == ["Master of Science"] and r.u == ["ABC", "G.H.Q."]


def test_page_labels(spark):
    df = spark.createDataFrame([("B.4", 60), (None, 61), ("", 62)], "printed string, page int")
    assert [r[0] for r in df.select(chunks.page_label(F.col("printed"), F.col("page"))).collect()] == ["Guide, page B.4 (physical page 60)", "Guide, physical page 61", "Guide, physical page 62"]
