"""Queries on inline rows, for rules that the driver's tables never trigger.

Their equivalents state the expected rows, worked out by hand from the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer, clean, outline, segment
from ..sources import files

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ------------------------------------------------------------------ files and pages


@query("""SELECT * FROM (VALUES ('a.txt', 'text'), ('B.MD', 'text'), ('c.markdown', 'text'), ('d.Pdf', 'pdf'), ('e.docx', 'unsupported'), ('README', 'unsupported'), ('.txt', 'unsupported')) t(name, kind)""")
def q_format_dispatch(spark, sf_dir):
    rows = [(n,) for n in ("a.txt", "B.MD", "c.markdown", "d.Pdf", "e.docx", "README", ".txt")]
    return spark.createDataFrame(rows, "name string").select("name", files.dispatch(F.col("name")).alias("kind"))


FILES = [
    ("Good Notes.md", b"# Title\n\nBody text.\n"),
    ("UP.TXT", b"plain \xff text"),
    ("report.docx", b"x"),
    ("bare", b"x"),
    ("blank.txt", b" \n\x0c \n"),
    ("scan.pdf", b"%PDF"),
]


@query("""SELECT * FROM (VALUES ('report.docx', 'UnsupportedDocumentError'), ('bare', 'UnsupportedDocumentError'), ('blank.txt', 'EmptyDocumentError'), ('scan.pdf', 'ExtractionError')) t(name, error)""")
def q_load_failures(spark, sf_dir):
    return files.load(files.from_bytes(spark, FILES))[2].select("name", "error")


@query("""SELECT source_file, CAST(page_number AS BIGINT) AS page_number, text FROM (VALUES ('Good Notes.md', 1, '# Title' || chr(10) || chr(10) || 'Body text.'), ('UP.TXT', 1, 'plain ' || chr(65533) || ' text')) t(source_file, page_number, text)""")
def q_load_documents(spark, sf_dir):
    documents, pages, _ = files.load(files.from_bytes(spark, FILES))
    return pages.join(documents, "doc_id").select("source_file", *_long("page_number"), "text")


TWINS = [
    ("notes.txt", b"first file"),
    ("notes.txt", b"second file\x0cits page"),
    ("other.md", b"line a\nline b"),
    ("other.md", b"line a\nline b"),
    ("bad.docx", b"x"),
    ("bad.docx", b"x"),
]


@query("""SELECT source_file, CAST(page_number AS BIGINT) AS page_number, text FROM (VALUES ('notes.txt', 1, 'first file'), ('notes.txt', 1, 'second file'), ('notes.txt', 2, 'its page'), ('other.md', 1, 'line a' || chr(10) || 'line b')) t(source_file, page_number, text)""")
def q_load_twins(spark, sf_dir):
    """Files of one name with different contents are two documents, a file given twice is one."""
    documents, pages, _ = files.load(files.from_bytes(spark, TWINS))
    return pages.join(documents, "doc_id").select("source_file", *_long("page_number"), "text")


class _Pages:
    """An extractor whose pages are the file's lines; it fails on contents that hold `poison`."""

    def __init__(self, poison: bytes, damage: bool = False):
        self.poison, self.damage = poison, damage

    def pages(self, content: bytes, name: str) -> list[str]:
        if self.poison in content:
            raise OSError("unreadable")
        return [line.replace(" ", "") if self.damage else line for line in content.decode().split("|")]


@query("""SELECT source_file, CAST(page_number AS BIGINT) AS page_number, text FROM (VALUES ('a.pdf', 1, 'some words that ran together'), ('a.pdf', 2, 'ok'), ('b.pdf', 1, 'fallback only'), ('a.pdf', 1, 'anotherfile')) t(source_file, page_number, text)""")
def q_load_pdfs(spark, sf_dir):
    """Two extractors: damaged pages come from the second, as do files that the first can't read."""
    rows = [
        ("a.pdf", b"some words that ran together|ok"),
        ("a.pdf", b"another file"),
        ("b.pdf", b"fallback only"),
        ("b.pdf", b"fallback only"),
    ]
    first, second = _Pages(b"fallback", damage=True), _Pages(b"never")
    documents, pages, _ = files.load(files.from_bytes(spark, rows), [first, second])
    return pages.join(documents, "doc_id").select("source_file", *_long("page_number"), "text")


@query("""SELECT name, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (VALUES ('lines', 0, 9), ('lines', 11, 20), ('words', 0, 9), ('words', 10, 18), ('run', 0, 10), ('run', 10, 14), ('back', 0, 8), ('back', 6, 11), ('back', 9, 14)) t(name, start, stop)""")
def q_hard_split(spark, sf_dir):
    """Ten characters at most: at blank lines, then blanks, then anywhere; the last one eight at most, with an overlap of four."""
    rows = spark.createDataFrame(
        [
            ("lines", "para one.\n\npara two."),
            ("words", "alpha bet gamma de"),
            ("run", "abcdefghijklmn"),
            ("back", "aa bb cc dd ee"),
        ],
        "name string, text string",
    )
    spans = F.when(F.col("name") == "back", segment.char_pieces(F.col("text"), 8, 4)).otherwise(segment.char_pieces(F.col("text"), 10))
    return rows.select("name", F.explode(spans).alias("p")).select(
        "name", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("stop")
    )


@query("""SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, text FROM (VALUES ('d', 1, 'one'), ('d', 2, ' '), ('d', 3, 'three'), ('e', 1, 'single')) t(doc_id, page_number, text)""")
def q_paginate(spark, sf_dir):
    rows = spark.createDataFrame([("d", "one\f \fthree"), ("e", "single")], "doc_id string, text string")
    return clean.paginate(rows).select("doc_id", *_long("page_number"), "text")


LONG = "Incomprehensibilities"


@query(f"""SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, text FROM (VALUES ('d', 1, 'all is well'), ('d', 2, 'the second page'), ('d', 3, '{LONG} {LONG}'), ('d', 4, '{LONG} here')) t(doc_id, page_number, text)""")
def q_page_repair(spark, sf_dir):
    main = [("d", 1, "all is well"), ("d", 2, f"{LONG} page"), ("d", 3, f"{LONG} {LONG}"), ("d", 4, f"{LONG} here")]
    spare = [("d", 1, "other"), ("d", 2, "the second page"), ("d", 3, LONG)]  # 3 is damaged too, 4 is missing
    schema = "doc_id string, page_number int, text string"
    return clean.repair_pages(
        spark.createDataFrame(main, schema), spark.createDataFrame(spare, schema)
    ).select("doc_id", *_long("page_number"), "text")


def _book(spark):
    """Five pages with a running head, a number line and a roman foot; body lines that repeat; then a
    document too short for the rule, and one that is furniture nearly throughout."""
    rows = [
        ("b", n, f"The Book\npage {n}\n\nBody {word}\nsame body\nmore {word}\n{roman}") for n, word, roman in (
            (1, "one", "i"), (2, "two", "ii"), (3, "three", "iii"), (4, "four", "iv"), (5, "five", "v")
        )
    ]
    rows += [("s", n, f"Head\nbody {n} x") for n in (1, 2)]
    rows += [("f", n, "Always the same line\nand again the same") for n in (1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, text string")


@query("""
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, text FROM (
SELECT 'b' AS doc_id, n AS page_number, chr(10) || 'Body ' || w || chr(10) || 'same body' || chr(10) || 'more ' || w AS text FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four'), (5, 'five')) v(n, w)
UNION ALL SELECT 's', n, 'Head' || chr(10) || 'body ' || n || ' x' FROM (VALUES (1), (2)) v(n)
UNION ALL SELECT 'f', n, 'Always the same line' || chr(10) || 'and again the same' FROM (VALUES (1), (2), (3)) v(n))
""")
def q_furniture(spark, sf_dir):
    return clean.strip_furniture(_book(spark)).select("doc_id", *_long("page_number"), "text")


@query("""SELECT doc_id, CAST(dropped AS BIGINT) AS dropped FROM (VALUES ('b', 15), ('s', 0), ('f', 6)) t(doc_id, dropped)""")
def q_furniture_guard(spark, sf_dir):
    """Lines in furniture runs; of document f all of them are, so q_furniture leaves it whole."""
    return clean.furniture_lines(_book(spark)).groupBy("doc_id").agg(F.count_if("drop").alias("dropped"))


HYPHENS = [
    ("a", 1, "Convolutional nets. A convolu-\ntional layer."),
    ("b", 1, "A position-wise map. It is position-\nwise."),
    ("c", 1, "Sugar rolls and honey rolls. The sugar-\nhoney glaze."),
    ("d", 1, "It was repre-\nsented well."),
    ("e", 1, "The Half-\nMoon stays."),
    ("f", 1, "An a-\nbb-\ncc chain."),
]


@query("""
SELECT doc_id, text FROM (VALUES ('a', 'Convolutional nets. A convolutional layer.'), ('b', 'A position-wise map. It is position-wise.'), ('c', 'Sugar rolls and honey rolls. The sugar-honey glaze.'),
('d', 'It was represented well.'), ('e', 'The Half-' || chr(10) || 'Moon stays.'), ('f', 'An abb-' || chr(10) || 'cc chain.')) t(doc_id, text)
""")
def q_dehyphenate(spark, sf_dir):
    return clean.rejoin_hyphens(spark.createDataFrame(HYPHENS, "doc_id string, page_number int, text string")).select("doc_id", "text")


@query("""SELECT * FROM (VALUES ('p', 'an,by,hand,it,known,line,well', 'e-mail,state-of'), ('q', '', '')) t(doc_id, words, pairs)""")
def q_vocabulary(spark, sf_dir):
    rows = [("p", 1, "It is-\nby hand, a well known line, e-mail"), ("p", 2, "an state-of x1 it"), ("q", 1, "a 1 b-2")]
    found = clean.vocabulary(spark.createDataFrame(rows, "doc_id string, page_number int, text string"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort("words"), ",").alias("words"),
        F.array_join(F.array_sort("pairs"), ",").alias("pairs"),
    )


@query("""SELECT span_id, CAST(page_number AS BIGINT) AS page_number FROM (VALUES ('tail', 2), ('even', 1), ('gap', 1), ('whole', 3), ('lost', NULL)) t(span_id, page_number)""")
def q_page_attribution(spark, sf_dir):
    pages = spark.createDataFrame(
        [("d", 1, 0, 100), ("d", 2, 101, 1001), ("d", 3, 1002, 1100)],
        "doc_id string, page_number int, start int, end int",
    )
    spans = [("d", "tail", 92, 1001), ("d", "even", 90, 111), ("d", "gap", 100, 101), ("d", "whole", 1002, 1100), ("x", "lost", 0, 5)]
    return clean.attribute_pages(
        spark.createDataFrame(spans, "doc_id string, span_id string, start int, end int"), pages
    ).select("span_id", *_long("page_number"))


# ------------------------------------------------------------------ outline and chunks

LINES = [
    "# Step one", "# Step 1", "1 Introduction", "1.2. Related Work", "3 Phase 2", "Contents ..... 4", "Figure 1 shows", "2 Figure of merit", "100 Big Number",
    "4 see http://x.org", "SYSTEM OVERVIEW", "KX1 KX2 KX3", "NOTE: BE CAREFUL NOW", "5 This heading ends with and", "6 Ends with a stop.", "7 lower case title",
    "One two three four five six seven eight nine ten eleven twelve thirteen", "  2.1 Indented Title", "8 X1",
]


@query("""
SELECT CAST(place AS BIGINT) AS place, text, kind, number FROM (VALUES (1, 'Step one', 'markdown', NULL), (3, '1 Introduction', 'numbered', '1'), (4, '1.2. Related Work', 'numbered', '1.2'),
(11, 'SYSTEM OVERVIEW', 'caps', NULL), (18, '2.1 Indented Title', 'numbered', '2.1')) t(place, text, kind, number)
""")
def q_heading_candidates(spark, sf_dir):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(LINES, 1)], "doc_id int, text string")
    return outline.heading_candidates(rows).select(
        F.col("doc_id").cast("long").alias("place"),
        "text",
        "kind",
        F.array_join(F.col("number").cast("array<string>"), ".").alias("number"),
    )


CHAINS = {
    "contents": [[1], [2], [1], [1, 1], [2], [3]],  # a copy of the outline before the body
    "axis": [[1], [50], [2], [52], [3]],
    "missed": [[2], [2, 1], [2, 2], [3, 2], [4]],  # "3" was not found
    "skips": [[1], [2, 1], [2, 2]],  # 1 to 2.1 is no step, 2.1 to 2.2 is
    "ties": [[5], [1]],
}


@query("""
SELECT * FROM (VALUES ('contents', '1:1 4:1.1 5:2 6:3'), ('axis', '1:1 3:2 5:3'), ('missed', '1:2 2:2.1 3:2.2 4:3.2 5:4'), ('skips', '2:2.1 3:2.2'), ('ties', '1:5')) t(doc_id, kept)
""")
def q_outline(spark, sf_dir):
    rows = [(name, at, ".".join(map(str, n)), "numbered", n) for name, chain in CHAINS.items() for at, n in enumerate(chain, 1)]
    kept = outline.outline(spark.createDataFrame(rows, "doc_id string, start long, text string, kind string, number array<int>"))
    item = F.struct("start", F.concat_ws(":", F.col("start").cast("string"), "text").alias("t"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("kept"))


SECTIONED = [("a", "Abstract here.\n1 First Part\nBody.\n2 Second Part\nEnd."), ("b", "No headings at all."), ("c", "1 Only Title\nText.")]


@query("""
SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, header, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (VALUES ('a', 0, NULL, 0, 15), ('a', 1, '1 First Part', 15, 34), ('a', 2, '2 Second Part', 34, 52),
('b', 0, NULL, 0, 19), ('c', 0, '1 Only Title', 0, 18)) t(doc_id, section_index, header, start, stop)
""")
def q_sections(spark, sf_dir):
    found = outline.sections(spark.createDataFrame(SECTIONED, "doc_id string, text string"))
    return found.select("doc_id", *_long("section_index"), "header", *_long("start"), F.col("end").cast("long").alias("stop"))


PACKS = {  # (topic, tokens) of each sentence
    "merge": [(0, 30), (1, 40), (2, 70), (3, 10)],
    "split": [(0, 200), (0, 200), (0, 200), (1, 100)],
    "hard": [(0, 100), (0, 600), (0, 50)],
    "two": [(0, 10), (0, 20)],
}


@query("""
SELECT section, CAST(i AS BIGINT) AS i, CAST(pack AS BIGINT) AS pack, hard FROM (VALUES ('merge', 0, 0, false), ('merge', 1, 0, false), ('merge', 2, 1, false), ('merge', 3, 1, false),
('split', 0, 0, false), ('split', 1, 0, false), ('split', 2, 1, false), ('split', 3, 2, false), ('hard', 0, 0, false), ('hard', 1, 1, true), ('hard', 2, 2, false), ('two', 0, 0, false), ('two', 1, 0, false)) t(section, i, pack, hard)
""")
def q_packing(spark, sf_dir):
    rows = [(s, i, topic, n) for s, sentences in PACKS.items() for i, (topic, n) in enumerate(sentences)]
    packed = segment.pack_sentences(spark.createDataFrame(rows, "section string, i int, topic int, n_tokens int"), ["section"])
    return packed.select("section", *_long("i", "pack"), "hard")


@query("""SELECT name, CAST(opening AS BIGINT) AS opening FROM (VALUES ('mid word', 17), ('at blank', 50), ('section start', 190), ('one long word', 200)) t(name, opening)""")
def q_overlap(spark, sf_dir):
    words = "abcde fghi " * 40  # an eleven-character period
    rows = [
        ("mid word", words, 0, 163),
        ("at blank", "x" * 49 + " " + "y" * 300, 0, 200),
        ("section start", "x" * 189 + " " + "y" * 200, 190, 250),
        ("one long word", "z" * 400, 0, 200),
    ]
    table = spark.createDataFrame(rows, "name string, text string, section_start int, start int")
    return table.select("name", segment.overlap_start(F.col("text"), F.col("section_start"), F.col("start")).cast("long").alias("opening"))


@query("""SELECT CAST(n AS BIGINT) AS n, chunk_id, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, header, CAST(page_number AS BIGINT) AS page_number FROM (VALUES
(0, 'd_p1_s0_0000', 0, 14, NULL, 1), (1, 'd_p1_s1_0001', 14, 30, '1 First Part', 1), (2, 'd_p2_s2_0002', 30, 53, '2 Second Part', 2)) t(n, chunk_id, char_start, char_end, header, page_number)""")
def q_chunk_table(spark, sf_dir):
    pages = spark.createDataFrame(
        [("d", 1, "Front matter.\n1 First Part\nAb"), ("d", 2, "2 Second Part\nCd ef gh.")],
        "doc_id string, page_number int, text string",
    )
    table = segment.chunk_table(spark.createDataFrame([("d", "d.txt")], "doc_id string, source_file string"), pages)
    return table.select(
        F.col("ord").alias("n"),
        "chunk_id",
        *_long("char_start", "char_end"),
        F.col("section_header").alias("header"),
        *_long("page_number"),
    )


# ------------------------------------------------------------------ answers

ANSWERS = ["See [1] and [2, 3].", "A 【2】 and ［1, 3］.", "重要【重要】 text [4]", "In [2020] and [1-3].", "Spaced [ 1 ] and [1].", "No marker."]


@query("""
SELECT CAST(n AS BIGINT) AS n, answer, markers FROM (VALUES (0, 'See [1] and [2, 3].', '1,2,3'), (1, 'A [2] and [1, 3].', '1,2,3'), (2, '重要【重要】 text [4]', '4'), (3, 'In [2020] and [1-3].', '2020'), (4, 'Spaced [ 1 ] and [1].', '1'), (5, 'No marker.', '')) t(n, answer, markers)
""")
def q_citations(spark, sf_dir):
    rows = spark.createDataFrame(
        list(enumerate(ANSWERS)), "n long, answer string"
    ).withColumn("answer", X.normalize_citations(F.col("answer")))
    return rows.select("n", "answer", F.array_join(X.cited_markers(F.col("answer")).cast("array<string>"), ",").alias("markers"))


@query("""SELECT CAST(marker AS BIGINT) AS marker, cited FROM (VALUES (1, true), (2, false), (3, true)) t(marker, cited)""")
def q_citation_marking(spark, sf_dir):
    context = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "query_id long, marker int")
    return answer.mark_citations(
        context, spark.createDataFrame([(7, "Yes [1], no [3, 9].")], "query_id long, answer string")
    ).select(*_long("marker"), "cited")


REPLIES = [
    "SUPPORTED: a\nUNSUPPORTED: b",
    "- supported: x\n* SUPPORTED: y\n• unsupported: z",
    "Verdicts\n1. SUPPORTED: not counted",
    "",
    "  UNSUPPORTED - q",
]


@query("""SELECT CAST(n AS BIGINT) AS n, score FROM (VALUES (0, 0.5::DOUBLE), (1, 0.666667::DOUBLE), (2, NULL), (3, NULL), (4, 0.0::DOUBLE)) t(n, score)""")
def q_judge_score(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(REPLIES)), "n long, reply string").select(
        "n", F.round(answer.judge_score(F.col("reply")), 6).alias("score")
    )


GROUNDED = [
    (0, "Cats purr [1].", 1, ["All cats purr."], None),
    (1, "Cats fly.", 1, ["All cats purr."], None),
    (2, "Cats purr.", 1, ["x"], "SUPPORTED: a"),
    (3, "Cats purr.", 1, ["x"], "SUPPORTED: a\nUNSUPPORTED: b\nUNSUPPORTED: c"),
    (4, X.REFUSAL, 1, ["x"], "SUPPORTED: a"),
    (5, "Anything.", 0, [], None),
    (6, "It is the.", 1, ["x"], "no verdicts"),
    (7, "Cats purr.", 1, ["x"], "SUPPORTED: a\nUNSUPPORTED: b"),
]


@query("""
SELECT CAST(query_id AS BIGINT) AS query_id, method, CAST(score AS DOUBLE) AS score, confidence, downgraded FROM (VALUES (0, 'overlap', 1.0, 'medium', false), (1, 'overlap', 0.5, 'medium', false), (2, 'judge', 1.0, 'high', false),
(3, 'judge', 0.333333, 'low', true), (4, NULL, NULL, NULL, false), (5, NULL, NULL, NULL, false), (6, 'overlap', 1.0, 'medium', false), (7, 'judge', 0.5, 'medium', false)) t(query_id, method, score, confidence, downgraded)
""")
def q_grounding(spark, sf_dir):
    rows = spark.createDataFrame(GROUNDED, "query_id long, answer string, n_context int, context array<string>, reply string")
    return answer.grounding(rows).select("query_id", "method", F.round("score", 6).alias("score"), "confidence", "downgraded")


CITED = [
    (1, 1, "report.pdf", "report-aaaa1111", 8, "5.4 Results", "One  two\nthree", False),
    (1, 2, "report.pdf", "report-bbbb2222", None, None, "cited text", True),
    (1, 3, "notes.md", "notes-cccc3333", None, "Intro", "w" * 279 + " tail", False),
]


@query(f"""
SELECT CAST(place AS BIGINT) AS place, heading, body FROM (VALUES (1, '**[2]** report.pdf (bbbb2222) — cited', '> cited text'), (2, '**[1]** report.pdf (aaaa1111) · p. 8 · 5.4 Results — not cited', '> One two three'),
(3, '**[3]** notes.md · Intro — not cited', '> {"w" * 279}…')) t(place, heading, body)
""")
def q_citation_view(spark, sf_dir):
    rows = spark.createDataFrame(
        CITED,
        "query_id long, marker int, source_file string, doc_id string, page_number int, section_header string, snippet string, cited boolean",
    )
    return answer.citation_view(rows).select(*_long("place"), "heading", "body")


@query("""SELECT CAST(1 AS BIGINT) AS query_id, CAST(1 AS BIGINT) AS n_cited, CAST(3 AS BIGINT) AS n_total, 'Sources: 1 of 3 excerpts cited' AS label""")
def q_citation_summary(spark, sf_dir):
    return answer.citation_summary(spark.createDataFrame([(1, True), (1, False), (1, False)], "query_id long, cited boolean"))


LLM_REPLIES = ["1. first\n2) second\n- third", '"quoted"\n\n  * starred ', "3.5 turbo cost\n-Xmx flag", "", "• dot\r\nplain"]


@query("""SELECT CAST(n AS BIGINT) AS n, lines FROM (VALUES (0, 'first|second|third'), (1, 'quoted|starred'), (2, '3.5 turbo cost|-Xmx flag'), (3, ''), (4, 'dot|plain')) t(n, lines)""")
def q_clean_lines(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(LLM_REPLIES)), "n long, reply string").select(
        "n", F.array_join(X.clean_lines(F.col("reply")), "|").alias("lines")
    )


QUESTIONS = [
    (0, " what is x ", "multi_query", "a\nb\nc\nd"),
    (1, "q1", "hyde", "- one\n- two"),
    (2, "q2", "rewrite", "better\nignored"),
    (3, "q3", "multi_query", None),
    (4, "q4", "odd", "a"),
    (5, "q5", "multi_query", "q5"),
]


@query("""
SELECT CAST(query_id AS BIGINT) AS query_id, mode, dense, sparse FROM (VALUES (0, 'multi_query', 'what is x|a|b|c', 'what is x|a|b|c'), (1, 'hyde', 'one two', 'q1'), (2, 'rewrite', 'better', 'better'), (3, 'none', 'q3', 'q3'), (4, 'none', 'q4', 'q4'), (5, 'multi_query', 'q5|q5', 'q5|q5')) t(query_id, mode, dense, sparse)
""")
def q_search_texts(spark, sf_dir):
    rows = answer.search_texts(spark.createDataFrame(QUESTIONS, "query_id long, question string, mode string, reply string"))
    side = lambda s: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("variant_no", "text")))),
            lambda x: x["text"],
        ),
        "|",
    ).alias(s)
    return rows.groupBy("query_id", "mode").agg(side("dense"), side("sparse"))


@query("""
SELECT CAST(n AS BIGINT) AS n, caption, note FROM (VALUES (0, 'transform: hyde · read as: full one · retrieved: 20 · in context: 5', '67% of the claims are supported by the excerpts.'),
(1, 'transform: none · retrieved: 0 · in context: 0', NULL), (2, 'transform: none · retrieved: 3 · in context: 1', '50% of the words appear in the excerpts; the claims were not checked one by one.')) t(n, caption, note)
""")
def q_captions(spark, sf_dir):
    rows = spark.createDataFrame(
        [
            (0, "hyde", "full one", 20, 5, 2 / 3, "judge"),
            (1, None, None, 0, 0, None, None),
            (2, "none", None, 3, 1, 0.5, "overlap"),
        ],
        "n long, mode string, standalone string, retrieved int, used int, score double, method string",
    )
    return rows.select(
        "n",
        answer.pipeline_caption(F.col("mode"), F.col("standalone"), F.col("retrieved"), F.col("used")).alias("caption"),
        answer.confidence_text(F.col("score"), F.col("method")).alias("note"),
    )


@query("""SELECT CAST(conv_id AS BIGINT) AS conv_id, prompt FROM (VALUES (1, 'Q: first?' || chr(10) || 'A: yes' || chr(10) || chr(10) || 'Follow-up question: and why?'), (2, 'Follow-up question: alone?')) t(conv_id, prompt)""")
def q_conversation_prompt(spark, sf_dir):
    turns = spark.createDataFrame([(1, 1, "first?", " yes ")], "conv_id long, turn_no int, question string, answer string")
    return answer.conversation_prompt(turns, spark.createDataFrame([(1, "and why?"), (2, "alone?")], "conv_id long, question string"))
