"""Each operator against a plain version of what it computes, and on awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.llm import bpe, common, graph, ngram_join, packing, pii, quality, sharding, subword, tiles, topk, toxicity, urlfilter, vecdedup

LONG = "wordy " * 20_000
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "the cat sat on the mat today"),
    (4, "the cat sat on the mat today"),
    (4, "the cat sat on the mat today"),
    (5, LONG),
    (None, "mail a.b@c.org or +1 (555) 010-9999 now"),
    (6, " \n "),
    (7, "x" * 30_000),
    (8, "Tür 日本 <|endoftext|> \x1c\x85"),
]
#: Names that the operators use themselves.
CLASHING = "size shard slot _slice key rep _text sig group node component score label _rank length spans ids _key _row _n chars copies links".split()


def clashing(table):
    return table.withColumns({n: F.lit("clash") for n in CLASHING})


@pytest.fixture(scope="module")
def awkward(spark):
    return clashing(spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long, size string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ------------------------------------------------------------------ 6 sharding


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, awkward, empty, documents):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(3).randrange(-(2**63), 2**63) for _ in range(500)]]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(
        "k", sharding.jump_shards(F.col("k"), [1, 16, 17, 100]).alias("s")
    ).collect()
    assert all([r.s.s0, r.s.s1, r.s.s2, r.s.s3] == [jump(r.k, n) for n in (1, 16, 17, 100)] for r in got)
    for table, rows in ((awkward, [(i, t) for i, t in AWKWARD]), (documents, documents.select("doc_id", "text").collect())):
        got = sharding.shard_documents(table).collect()
        want = sorted(
            (
                i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 16), jump(i or 0, 17)
            ) for i, t in rows
        )
        assert sorted((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
        assert all(r.grown_shard in (r.shard, 16) for r in got)
        for s in range(16):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


# ------------------------------------------------------------------ 3 urls


def plain_verdict(host, path, rules, default="allow"):
    fits = [r for r in rules if (r[0] == "" or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return None, default
    top = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"))
    return top[0] + top[1], top[2]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark, sf_dir):
    rng = random.Random(5)
    labels = ["a", "b", "example", "org", "com", "www"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randrange(0, 4)))
    rules = list(
        {
            (h, p): (h, p, rng.choice(["allow", "block"])) for h, p in (
                (host(), path()[: rng.randrange(0, 6)]) for _ in range(60)
            )
        }.values()
    )
    rules += [("org", "", "allow"), ("org", "", "block")] if not any(r[:2] == ("org", "") for r in rules) else []
    urls = [f"http://{host()}{path()}" for _ in range(800)] + [
        None,
        "",
        "no scheme",
        "http://",
        "HTTP://WWW.Example.ORG/ES/?q#f",
        "http://a.org?x",
        "://org",
        "http://É.org:80/x",
        "http://org./x",
        "http://x..org/",
        "http://a\nb.org/y\nz",
        "http://a.org/" + "x" * 5000,
        "http://" + "a." * 400 + "org/y",
    ] + ["http://hot.org/x"] * 500
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns(
        {"key": F.lit(1), "place": F.lit(2), "pid": F.lit(3), "kind": F.lit(4)}
    )
    got = urlfilter.filter_urls(table, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        h, p = plain_parts(urls[r.page_id])
        assert (r.host, r.path) == (h, p)
        want = plain_verdict(h, p, rules) if h else (None, "allow")
        assert (r.rule, r.verdict) == want, (urls[r.page_id], r, want)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urlfilter.filter_urls(table, none, "block").collect()} == {"block"}
    assert urlfilter.filter_urls(table.limit(0), none).count() == 0


def test_urls_sql(spark, sf_dir, duck):
    got = sorted(map(repr, map(tuple, urlfilter.op3_url_filters(spark, sf_dir).collect())))
    assert got == sorted(map(repr, duck.execute(urlfilter.URL_FILTER_SQL).fetchall()))


# ------------------------------------------------------------------ 8 personal data

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
}


def plain_base(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data_base():
    rng = random.Random(9)
    bits = [
        "a",
        "b.c",
        "@",
        "@",
        "x@y.z",
        ".",
        "-",
        "+",
        " ",
        "1",
        "23",
        "4111 1111 1111 1111",
        "4111111111111111",
        "192.168.0.1",
        "999.1.1.1",
        "0255.001.0.0",
        "+1 (555) 010-9999",
        "é",
        "%",
        "\n",
        "00",
        "5500-0000-0000-0004",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert [s[:3] for s in pii.find_pii(text) if s[0] in pii.BASE_KINDS] == plain_base(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "1-" * 100_000, "ab1" * 70_000, "key " + "a1b2c3-" * 30_000):  # linear time
        pii.find_pii(text)


def test_personal_data_more(spark, awkward, empty):
    assert [s[0] for s in pii.find_pii("IBAN GB82 WEST 1234 5698 7654 32 AND MORE")] == ["iban"]
    assert not pii.find_pii("code GB82 WEST 1234 5698 7654 33") and not pii.find_pii("range 123-45-6789")
    assert [s[0] for s in pii.find_pii("her SSN is 123-45-6789")] == ["ssn"]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert pii.find_pii(f'token = "{key}"') == [("secret", 9, 49, 0.8)] and not pii.find_pii(f"commit {key}") and pii.redact(f'TOKEN = "{key.upper()}"!!') == 'TOKEN = "[SECRET]"!!'
    assert not pii.find_pii("key incomprehensibilities key aaaa1111aaaa1111aaaa") and not pii.find_pii("password 1111222233334445")
    assert [s[0] for s in pii.find_pii("account 12345678")] == ["account"] and not pii.find_pii("number 12345678")
    assert pii.redact("write x@y.org, 4111 1111 1111 1111") == "write [EMAIL], [CARD]"
    got = {r.doc_id: r.spans for r in pii.pii_spans(awkward).collect()}
    assert [s.kind for s in got[None]] == ["email", "phone"] and not got[1] and len(got) == 9
    kept = pii.redact_pii(awkward)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    assert {
        (r.text, r.n_chars) for r in kept.where("doc_id is null or doc_id = 1").collect()
    } == {("mail [EMAIL] or [PHONE] now", 27), (None, None)}
    assert pii.pii_spans(empty).count() == 0 and pii.redact_pii(empty).count() == 0


def test_personal_data_query(spark, sf_dir, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.op8_pii_spans(spark, sf_dir).collect():
        base = plain_base(text[r.doc_id])
        assert r.has_any == int(r.spans != "") and len(r.scores.split(",")) == len(r.spans.split(",")) and r.n_secret == r.spans.count("secret:")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) == (digest, *[sum(x[0] == k for x in base) for k in pii.BASE_KINDS])


# ------------------------------------------------------------------ 9 tokens


def whole_coder():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_parts_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    whole, ours, tokens = whole_coder(), bpe.load(bpe.default_ranks()), packing.load_tokens(packing.default_tokenizer())
    hf = Tokenizer.from_file(packing.default_tokenizer())
    hf.encode_special_tokens = True
    rng = random.Random(1)
    letters = " \n\t\r  'stm'llréab1²½_.!<|endoftext|>é日本 　\x1c\x85\xa0ⅷ "
    for size in (1 << 16, 5):
        monkeypatch.setattr(bpe, "PART", size)
        for _ in range(1500):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
            want = whole.encode_ordinary(t)
            assert "".join(bpe.parts(t, size)) == t
            assert ours.encode(t) == want == hf.encode(t, add_special_tokens=False).ids, t
            assert [i for p in bpe.parts(t, size) for i in ours.encode(p)] == want, t
            assert np.frombuffer(tokens.ids(t), "<u4").tolist() == want and ours.decode(want) == t.encode()
    assert len(ours.encode(" " * 3_000_000 + "a")) > 0  # no backtracking stack


def test_bpe_documents(spark, awkward, empty):
    whole, ours = whole_coder(), bpe.load(bpe.default_ranks())
    got = bpe.round_trip(awkward).collect()
    want = sorted(
        (
            len(i),
            hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest(),
        ) for _, t in AWKWARD for i in [whole.encode_ordinary(t or "")]
    )
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode_documents(bpe.encode_documents(awkward)).collect()
    assert sorted(bytes(r.content) for r in back) == sorted((t or "").encode() for _, t in AWKWARD)
    assert bpe.round_trip(empty).count() == 0 and ours.digits[-1] == "50255"


# ------------------------------------------------------------------ 1 packing


def optimum(sizes, capacity):
    """The least number of bins, by trying everything."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def check_patterns(patterns, counts, capacity):
    held = np.zeros_like(counts)
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        np.add.at(held, list(pattern), times)
    assert (held == counts).all()


def test_bins():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 12))]
        counts = np.bincount(sizes, minlength=31)
        patterns, bound = packing.bin_completion(counts, 30)
        check_patterns(patterns, counts, 30)
        best = optimum(sizes, 30)
        assert bound <= best <= sum(t for _, t in patterns) <= sum(t for _, t in packing.best_fit_decreasing(counts, 30))
        assert sum(t for _, t in patterns) == best, sizes
    counts = np.bincount([rng.randrange(1, 101) for _ in range(20_000)], minlength=101)
    patterns, bound = packing.bin_completion(counts, 100, nodes=300)
    check_patterns(patterns, counts, 100)
    table = packing.layout(patterns)
    spans = {}
    for size in np.flatnonzero(counts):
        sequence, offset = packing.place(table, np.full(counts[size], size), np.arange(counts[size]))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            spans.setdefault(s, []).append((o, size))
    for parts in spans.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 100
    assert packing.dominated((3, 2), (5,)) and not packing.dominated((3, 3), (5,)) and packing.bin_completion(np.zeros(31, int), 30) == ([], 0)


@pytest.mark.parametrize(("low", "high", "most"), [(200, 400, 2950), (250, 340, 2896), (350, 500, 4300)])
def test_bins_of_short_pieces(low, high, most):
    counts = np.bincount(np.random.default_rng(1).integers(low, high + 1, 20_000), minlength=2049)
    patterns, bound = packing.bin_completion(counts, 2048)
    check_patterns(patterns, counts, 2048)
    bins = sum(t for _, t in patterns)
    assert bound <= bins <= most < sum(t for _, t in packing.best_fit_decreasing(counts, 2048))


def test_bins_of_many_documents():
    """The lengths of the documents of sf0.1, ten times over: proven optimal, unlike best-fit decreasing."""
    import duckdb

    tokens, counts = packing.load_tokens(packing.default_tokenizer()), np.zeros(2049, np.int64)
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall():
        for _, n in packing.cut(len(tokens.ids(text or "")) // 4 + 1, 2048):
            counts[n] += 10
    patterns, bound = packing.bin_completion(counts, 2048)
    check_patterns(patterns, counts, 2048)
    assert sum(t for _, t in patterns) == bound < sum(t for _, t in packing.best_fit_decreasing(counts, 2048))


def test_fillings_of_any_number_of_pieces():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted(rng.randrange(3, 12) for _ in range(rng.randrange(1, 9)))
        counts, room = np.bincount(sizes, minlength=31), rng.randrange(31)
        subsets = {tuple(s for k, s in enumerate(sizes[::-1]) if m >> k & 1) for m in range(1 << len(sizes))}
        fit = sorted((f for f in subsets if sum(f) <= room), key=sum)
        got = list(packing.fillings(counts, room, room))
        assert len(set(got)) == len(got) and set(got) <= set(fit) and sum(got[0]) == sum(fit[-1])
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
        assert all(any(packing.dominated(f, g) for g in got) for f in fit if f)


def check_packed(rows, texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(packing.default_tokenizer())
    hf.encode_special_tokens = True
    want = []
    for i, t in texts:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for n, a in enumerate(cuts):
            part = ids[a : cuts[n + 1] if n + 1 < len(cuts) else len(ids)]
            want.append((i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


def test_packing(spark, awkward, empty, documents):
    check_packed(packing.pack_documents(awkward).collect(), AWKWARD)
    rows = packing.pack_documents(documents).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in documents.collect()])
    counts = np.bincount([r.length for r in rows], minlength=packing.CAPACITY + 1)
    assert n <= packing.lower_bound(counts, packing.CAPACITY) * 1.01 + 1
    assert {(r.n_sequences, r.n_sequences_least) for r in rows} == {(n, packing.lower_bound(counts, packing.CAPACITY))}
    assert packing.pack_documents(empty).count() == 0
    held = packing.pack_documents(documents.limit(5), keep_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in held)


# ------------------------------------------------------------------ 2 n-grams


def plain_links(rows):
    """(links, component) by row, from all pairs."""
    sets = [
        {
            tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))
        } if (w := re.findall(r"\w+", (t or "").lower())) else set() for _, t in rows
    ]
    n = len(rows)
    near = [
        [
            i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12 for j in range(n)
        ] for i in range(n)
    ]
    component = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([component[i], *[component[j] for j in range(n) if near[i][j]]])
            if low != component[i]:
                component[i], changed = low, True
    least = {}
    for i, c in enumerate(component):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], sum(near[i]), least.get(component[i])) for i in range(n)]


def near_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(40):  # a group of near copies of one text
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(120)] = word()
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join([*base[:60], *[word() for _ in range(60 + i)]])) for i in range(10)]  # a shared passage
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, "a b c"), (303, "A b, c!"), (304, "a b d")]
    return rows + AWKWARD


@pytest.mark.parametrize("block", [None, 8])
def test_ngram_join(spark, monkeypatch, block):
    if block:  # many tiles
        monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
        monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", block)
    rows = near_rows()
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = ngram_join.ngram_jaccard_join(table).collect()
    assert sorted(map(repr, plain_links(rows))) == sorted(repr((r.doc_id, r.n_links, r.component_id)) for r in got)
    if block:
        kept = ngram_join.keep_one(table)
        assert kept.columns == table.columns
        want = {}
        for (i, t), (_, n, c) in zip(rows, plain_links(rows)):
            if i == c and (n or True):
                want.setdefault((i, t) if n else (i, t, len(want)), 1)
        assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(k[:2]) for k in want)


def test_one_text_stays_where_ids_lack_or_repeat(spark):
    words = [f"w{i}" for i in range(80)]
    near = [" ".join([*words[:79], f"x{k}"]) for k in range(4)]
    far = [" ".join([*words[::-1][:79], f"y{k}"]) for k in range(3)]
    rows = [(None, t) for t in near] + [(None, near[0])] + [(7, t) for t in far] + [(9, far[0]), (None, "alone here"), (7, "alone too")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_one(table).collect()
    assert sorted(repr(r.doc_id) for r in kept) == ["7", "7", "None", "None"]
    assert sum(r.text in near for r in kept) == sum(r.text in far for r in kept) == 1
    judged = ngram_join.ngram_jaccard_join(table).collect()
    assert len({r.key for r in judged if r.kept}) == 4 and [r.kept for r in judged if r.doc_id == 9] == [False]


def test_common_keys_are_joined_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = common.join_by_size(rows, side, ["k"], "n", 5000).select("k", "id", "n", "least").collect()
    assert sorted(map(tuple, got)) == [(0 if i < 3000 else i, i, 3000 if i < 3000 else 1, 0 if i < 3000 else i) for i in sorted(range(5000), key=lambda i: (0 if i < 3000 else i, i))]


def test_many_copies(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(i, text) for i in range(1500)] + [(1500 + i, near) for i in range(3)] + [(7, text)] * 300 + [(9999, "alone in here")]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.n_links, r.component_id) for r in got if r.doc_id != 9999} == {(1802, 0)}
    assert sorted(r.doc_id for r in got if r.kept) == [0, 9999]
    vectors = [(i, [1.0, 0.0, 2.0]) for i in range(1500)] + [(2000, [1.0, 0.01, 2.0]), (2001, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = vecdedup.dedup_vectors(table).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1500, 0), (0, 2001)} and sorted(r.vec_id for r in got if r.kept) == [0, 2001]


def test_ngram_join_on_the_corpus(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = ngram_join.ngram_jaccard_join(documents).collect()
    assert sorted(map(repr, plain_links(rows))) == sorted(repr((r.doc_id, r.n_links, r.component_id)) for r in got)


def test_forest_depth_and_empty(spark, empty):
    d = ngram_join.depth()
    recall = lambda x: 1 - (1 - 0.8**x) ** ngram_join.TREES
    assert recall(d) >= ngram_join.TARGET and (d == ngram_join.LEVELS or recall(d + 1) < ngram_join.TARGET)
    assert ngram_join.ngram_jaccard_join(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_prefixes_are_shortened_until_the_target():
    rng = random.Random(3)
    levels, top = ngram_join.LEVELS, ngram_join.depth()
    seen = set()
    for _ in range(200):
        runs = [sorted(rng.random() for _ in range(levels - top + 1)) for _ in range(rng.randrange(ngram_join.TREES + 1))]
        depths = ngram_join.choose_depths(runs, ngram_join.TREES - len(runs))
        miss = (1 - 0.8**top) ** (ngram_join.TREES - len(runs)) * np.prod([1 - 0.8**d for d in depths])
        assert miss <= 1 - ngram_join.TARGET + 1e-12 and all(top <= d <= levels for d in depths)
        seen |= set(depths)
        if any(d < levels for d in depths):  # no shorter than needed: the last step was one too few before
            j = max((j for j, d in enumerate(depths) if d < levels), key=lambda j: runs[j][levels - depths[j]])
            assert miss / (1 - 0.8 ** depths[j]) * (1 - 0.8 ** (depths[j] + 1)) > 1 - ngram_join.TARGET
    assert seen == set(range(top, levels + 1))


def test_runs_are_cut_at_their_own_depth(spark):
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2, (300, ngram_join.TREES, ngram_join.LEVELS)).astype("<u2")  # crowded tries
    sig[200:, :10] = rng.integers(0, 1 << 16, sig[200:, :10].shape)  # the second kind is alone in ten trees
    classes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "node long, sig binary")
    run_of = {}
    for r in ngram_join._matched(classes).collect():
        run_of.setdefault(r.run, set()).add(r.node)
    lengths = set()
    for members in run_of.values():  # a run is all texts that share a prefix in one tree
        members = sorted(members)
        fits = [
            (j, d) for j in range(ngram_join.TREES) for d in range(ngram_join.LEVELS, ngram_join.depth() - 1, -1) if set(members) == set(
                np.flatnonzero((sig[:, j, :d] == sig[members[0], j, :d]).all(axis=1)).tolist()
            )
        ]
        assert fits
        lengths.add(max(d for _, d in fits))
    assert len(lengths) > 1
    for i in range(300):  # each text reaches the target by the depths of its runs, alone counting as the shortest
        depths = []
        for j in range(ngram_join.TREES):
            runs = [
                m for m in run_of.values() if i in m and any(
                    set(m) == set(
                        np.flatnonzero((sig[:, j, :d] == sig[i, j, :d]).all(axis=1)).tolist()
                    ) for d in range(ngram_join.depth(), ngram_join.LEVELS + 1)
                )
            ]
            sizes = [
                set(
                    np.flatnonzero((sig[:, j, :d] == sig[i, j, :d]).all(axis=1)).tolist()
                ) for d in range(ngram_join.depth(), ngram_join.LEVELS + 1)
            ]
            depths.append(
                min(
                    [d + ngram_join.depth() for d, m in enumerate(sizes) if m in runs],
                    default=ngram_join.LEVELS if len(sizes[0]) > 1 else ngram_join.depth(),
                )
            )
        assert np.prod([1 - 0.8**d for d in depths]) <= 1 - ngram_join.TARGET + 1e-12
        if i > 20:
            break


def test_components_of_a_hub(spark):
    star = spark.range(1, 3001).select("id", F.lit(0).cast("long").alias("b")).toDF("a", "b")
    chain = spark.range(5000, 5060).select("id", F.col("id") + 1).toDF("a", "b")
    got = {r.node: r.component for r in graph.components(star.unionByName(chain)).collect()}
    assert got == dict.fromkeys(range(3001), 0) | dict.fromkeys(range(5000, 5061), 5000)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)
    ]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert tiles.forest(lambda r: np.zeros((len(r), 3), bool), 3) == []


# ------------------------------------------------------------------ 5 and 7 vectors


def vector_rows(seed=6, n=400, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = np.concatenate(
        [rng.normal(size=(n, d)), (centres[:, None] + 0.18 * rng.normal(size=(12, 14, d))).reshape(-1, d)]
    ).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [
        (900, rows[5][1]),
        (901, rows[5][1]),
        (901, rows[5][1]),
        (902, [2 * a for a in rows[5][1]]),
        (903, None),
        (904, [0.0] * d),
        (905, [None] + [1.0] * (d - 1)),
        (906, [float("nan")] * d),
        (907, [float("inf")] * d),
        (908, []),
        (909, [1e-30] * d),
        (910, [1e30] * d),
        (911, [1.0, 2.0]),
        (912, [2.0, 4.0]),
        (913, [-0.0] + [1.0] * (d - 1)),
        (914, [0.0] + [1.0] * (d - 1)),
    ]


def sound(v):
    return v is not None and all(a is not None and np.isfinite(a) for a in v)


def plain_vectors(rows, t=0.95):
    good = [sound(v) and any(v) for _, v in rows]
    unit = [vecdedup.unit(np.array([v], np.float64))[0] if g else None for (_, v), g in zip(rows, good)]
    n = len(rows)
    near = [
        [
            j for j in range(n) if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t
        ] for i in range(n)
    ]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *[label[j] for j in near[i]]]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for i in range(n):
        least[label[i]] = min(least.get(label[i], rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(near[i]), least[label[i]]) for i in range(n))


@pytest.mark.parametrize(("block", "pivots"), [(4096, None), (40, 6)])
def test_vector_dedup(spark, block, pivots):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"e": F.lit(1), "h1": F.lit(2), "node": F.lit(3), "label": F.lit(4), "cell": F.lit(5)}
    )
    got = vecdedup.dedup_vectors(table, block=block, pivots=pivots).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_dedup_empty(spark):
    assert vecdedup.dedup_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantised_bound():
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1, 30):
        x, y = (vecdedup.unit(rng.normal(size=(300, 24)) * np.exp(scale * rng.normal(size=(300, 24)) / 10)) for _ in range(2))
        (cx, sx, ex), (cy, sy, ey) = vecdedup.quantise(x), vecdedup.quantise(y)
        near = (cx.astype(float) @ cy.T.astype(float)) * sx[:, None] * sy
        assert (np.abs(x @ y.T - near) <= ex[:, None] + (1 + ex[:, None]) * ey + 1e-12).all()


def plain_top(rows, query, k):
    """Row by row: (query_id, rank, vec_id, score)."""
    rows = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if sound(v)]
    out = []
    for a, (i, q) in enumerate(rows):
        if query(i):
            best = sorted((-int(q @ c), j) for b, (j, c) in enumerate(rows) if b != a and len(c) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "band", "span"), [(4096, 8192, 16), (50, 3, 2), (7, 100, 1)])
def test_top_k(spark, block, band, span):
    rows = [r for r in vector_rows() if r[0] != 910]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"x": F.lit(1), "score": F.lit(2), "_row": F.lit(3), "rank": F.lit(4), "side": F.lit(5), "name": F.lit(6)}
    )
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, block=block, band=band, span=span)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 50 == 0, 5)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    few = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [3.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5])]
    assert sorted(
        map(tuple, topk.top_k(spark.createDataFrame(few, schema), F.col("vec_id") % 50 == 0).collect())
    ) == plain_top(few, lambda i: i % 50 == 0, 5)
    bare = [(0, []), (3, []), (50, []), (None, [])]
    assert sorted(
        map(tuple, topk.top_k(spark.createDataFrame(bare, schema), F.col("vec_id") % 50 == 0).collect())
    ) == [(0, 1, 3, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0)]


def test_top_k_of_huge_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * s).astype(np.float32).tolist()) for i, s in enumerate(np.repeat([1, 1e4, 1e9, 1e16, 1e30, 1e37], 20))]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, block=30).collect()
    whole = [[int(np.floor(256 * np.float64(a))) for a in v] for _, v in rows]
    want = []
    for i in range(0, len(rows), 10):
        best = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in range(len(rows)) if j != i)[:5]
        want += [(i, n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_segment_bounds():
    rng = np.random.default_rng(2)
    for width in (1, 3, 24, 32):
        x, y = rng.integers(-300, 300, (80, width)).astype(float), rng.integers(-300, 300, (90, width)).astype(float)
        a, b = topk.Levels(x), topk.Levels(y)
        last = np.full((80, 90), np.inf)
        for k, end in enumerate(a.ends):
            bound = a.all[:, :end] @ b.all[:, :end].T + a.left[k] @ b.left[k].T
            assert (bound >= x @ y.T - 1e-6).all() and (k > 2 or (bound <= last + 1e-6).all())
            last = bound
        assert np.allclose(bound, x @ y.T)
    x = rng.normal(size=(5, 16))  # a level's sums and deviations are those of its segments
    a = topk.Levels(x)
    for k in range(3):
        parts = np.stack(np.split(x, 2**k, axis=1), axis=1)
        m = 16 // 2**k
        assert np.allclose(
            (a.all[:, : a.ends[k]] ** 2).sum(1), (m * parts.mean(2) ** 2).sum(1)
        ) and np.allclose(a.left[k], np.sqrt(m) * parts.std(2))


def test_levels_spare_work():
    """Smooth rows need a fraction of all multiply-adds, rows without any structure hardly more than all."""
    rng = np.random.default_rng(7)
    steps = np.floor(256 * np.cumsum(rng.normal(size=(6000, 64)), axis=1))
    noise = np.floor(256 * rng.normal(size=(6000, 64)) / 8)
    for x, most in ((steps, 0.25), (noise, 1.25)):
        best = topk.Best(x[:256], np.arange(256), 5)
        for at in range(0, len(x), 3000):
            best.meet(x[at : at + 3000], np.arange(at, at + 3000), np.arange(at, at + 3000))
        score = x[:256] @ x.T
        score[np.arange(256), np.arange(256)] = -np.inf
        assert all([-s for s, *_ in best.found[i]] == sorted(score[i])[:-6:-1] for i in range(256))
        print(best.work / score.size / 64)
        assert best.work < most * score.size * 64


# ------------------------------------------------------------------ 4 and 10 classifiers


def toy(n, seed, bad):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(3, 150))]
        y = i % 2
        rows.append((bad(rng, w) if y else " ".join(w), y))
    return rows


def insult(rng, words):
    for _ in range(2):
        words.insert(rng.randrange(len(words) + 1), rng.choice(["vexnu", "vexta", "vexor", "krollo"]))
    return " ".join(words)


def test_toxicity_learns(spark, awkward, empty):
    model = toxicity.fit(toy(400, 1, insult))
    test = toy(200, 2, insult)
    score = toxicity.Scorer(model).scores([t for t, _ in test])
    assert ((score >= 0.5) == np.array([y for _, y in test])).mean() >= 0.95
    assert ((score >= 0) & (score <= 1)).all()
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(awkward, model).collect()}
    assert got[1] == got[2] == got[6] < 0.5 and got[3] == got[4]
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns
    assert toxicity.score_toxicity(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    one = toxicity.fit([("a", 0), ("b", 0)])
    assert toxicity.Scorer(one).scores(["x", ""]).tolist() == [0, 0] and toxicity.fit([]).constant == 0


def plain_toxicity(model, text):
    """The score of one text by loops over stretches, words and windows."""
    words = toxicity.words_of(text)
    sig = lambda x: 1 / (1 + np.exp(-x))
    vocabulary = subword.Vocabulary(toxicity.BUCKETS, toxicity.GRAMS)
    p = {k: v.astype(np.float64) for k, v in model.par.items()}
    x = []
    for w in words:
        whole, grams, _ = vocabulary.features(vocabulary.add([w]))
        x.append(np.concatenate([model.word[whole[0]], model.char[grams].sum(axis=0) / np.sqrt(len(grams))]).astype(np.float64))

    def walk(d, places):
        h, out = np.zeros(toxicity.HIDDEN), {}
        for i in places:
            z, r = (sig(x[i] @ p["W"][g, d] + p["b"][g, d, 0] + h @ p["U"][g, d]) for g in (0, 1))
            n = np.tanh(x[i] @ p["W"][2, d] + p["b"][2, d, 0] + r * (h @ p["U"][2, d]))
            h = n + z * (h - n)
            out[i] = h
        return out

    weight, value = np.zeros(len(words)), np.zeros(len(words))
    for a in range(0, len(words), toxicity.STEP):
        reach = [i for i in range(a - toxicity.CONTEXT, a + toxicity.STEP + toxicity.CONTEXT) if 0 <= i < len(words)]
        left, right = walk(0, reach), walk(1, reach[::-1])
        for i in range(a, min(a + toxicity.STEP, len(words))):
            h = np.concatenate([left[i], right[i]])
            weight[i], value[i] = np.exp(np.tanh(h @ p["A"]) @ p["v"]), h @ p["o"]
    windows = [slice(a, a + toxicity.WINDOW) for a in range(max(len(words) - toxicity.WINDOW, 0) + 1)]
    z = [(weight[s] * value[s]).sum() / weight[s].sum() + p["c"][0] for s in windows]
    return sig(model.scale * max(z) + model.shift)


def test_toxicity_scores_every_window():
    model = toxicity.fit(toy(200, 1, insult))
    words = " ".join(t for t, _ in toy(8, 2, insult)).split()
    group = [" ".join(words[a : a + n]) for a, n in ((0, 1), (3, 31), (5, 32), (7, 33), (1, 64), (2, 65), (9, 100), (0, 300))]
    assert np.allclose(toxicity.Scorer(model).scores(group), [plain_toxicity(model, t) for t in group], atol=5e-4)


def test_toxicity_of_a_text_is_its_own(monkeypatch):
    model = toxicity.fit(toy(100, 1, insult), epochs=1)
    group = [t for t, _ in toy(30, 5, insult)] + ["", "x" * 300_000, "y " * 5000]
    want = toxicity.Scorer(model).scores(group)
    monkeypatch.setattr(toxicity, "REMEMBERED", 60)  # words are forgotten
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    small = toxicity.Scorer(model)
    assert np.allclose(np.concatenate([small.scores([t]) for t in group]), want, atol=5e-4)


def test_features_of_long_words(monkeypatch):
    word = "".join(random.Random(2).choice("abcé") for _ in range(3000))
    whole, grams, _ = subword.features([word], 1 << 16, (3, 5))
    monkeypatch.setattr(subword, "PART", 100)
    h, f, _ = subword.long_features(word, 1 << 16, (3, 5))
    assert h.tolist() == whole.tolist() and sorted(f.tolist()) == sorted(grams.tolist())


def test_long_texts_are_fitted_too(spark):
    rows = [(i, f"t{i} " * (20 if i % 2 else 5)) for i in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        [(i, i % 2) for i, _ in rows], "doc_id long, toxic int"
    )
    pick = lambda per_class, max_chars: [
        (r.text, r.label) for r in common.training_rows(docs, labels, "toxic", None, per_class, max_chars).collect()
    ]
    got = pick((8, 10), 40)  # class 1 has long texts only: whole ones up to 10 * 40 characters
    assert sum(y == 0 for _, y in got) == 8 and 5 <= sum(y for _, y in got) <= 7 and all(t in dict(rows).values() for t, _ in got)
    assert {y for _, y in pick((1, 1), 10)} == {0, 1} and all(len(t) <= 10 for t, _ in pick((1, 1), 10))
    mixed = docs.withColumn("text", F.when(F.col("doc_id") >= 20, F.col("text")).otherwise(F.repeat(F.lit("long "), 100)))
    got = [(r.text, r.label) for r in common.training_rows(mixed.union(mixed), labels, "toxic", None, (8, 8), 100).collect()]  # the short ones fill the classes, each once
    assert [sum(y == k for _, y in got) for k in (0, 1)] == [8, 8]
    assert common.training_rows(docs.limit(0), labels, "toxic", None, (1, 1), 10).count() == 0
    assert common.fit_in_task(
        common.training_rows(docs, labels.limit(0), "toxic", None, (1, 1), 10), len
    ) == 0 and common.fit_in_task(common.training_rows(docs, labels, "toxic", None, (3, 4), 400), len) == 7


def test_toxicity_gradient():
    rng = np.random.default_rng(3)
    par = {k: v.astype(np.float64) for k, v in toxicity.new_model(rng).par.items()}
    x = rng.normal(size=(40, 2 * toxicity.DIM))
    size = np.array([20, 150])
    rows = [np.where((p < 0) | (p >= n), len(x), rng.integers(0, len(x), p.shape)) for n in size for p in [toxicity.stretches(n)]]
    at, target, gain = np.concatenate(rows), np.array([1.0, 0.0]), np.array([1.0, 0.7])
    loss = lambda p, x: toxicity.gradients(p, x, at, size, target, gain, 2.0)[0]
    _, grad, d_x = toxicity.gradients(par, x, at, size, target, gain, 2.0)
    for name in par:
        for _ in range(3):
            place = tuple(rng.integers(0, s) for s in par[name].shape)
            up, down = ({k: v.copy() for k, v in par.items()} for _ in range(2))
            up[name][place] += 1e-4
            down[name][place] -= 1e-4
            assert np.isclose((loss(up, x) - loss(down, x)) / 2e-4, grad[name].reshape(par[name].shape)[place], rtol=1e-3, atol=1e-7), name
    a, b = x.copy(), x.copy()
    a[3, 5] += 1e-4
    b[3, 5] -= 1e-4
    assert np.isclose((loss(par, a) - loss(par, b)) / 2e-4, d_x[3, 5], rtol=1e-3, atol=1e-7)


def shout(rng, words):
    return " ".join(w.upper() + "!!" for w in words)


def test_quality_learns(spark, awkward, empty):
    model = quality.fit([(t, 1 - y) for t, y in toy(300, 3, shout)])
    test = toy(100, 4, shout)
    score = quality.Scorer(model).scores([t for t, _ in test])
    assert ((score < 0.5) == np.array([y for _, y in test])).mean() >= 0.95
    got = {r.doc_id: r.score for r in quality.score_quality(awkward, model).collect()}
    assert got[1] == got[2] == got[6] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.keep_quality(awkward, model).columns == awkward.columns
    assert quality.score_quality(empty, model).count() == 0 and quality.keep_quality(empty, model).count() == 0
    assert quality.fit([]).constant == 0.5 and quality.Scorer(quality.fit([("a", 1)])).scores(["x"]).tolist() == [1.0]


def plain_quality(model, text):
    """The score of one text by loops over words, n-grams and bigrams."""
    words, parts = text.split(), []
    h = lambda x: int(subword.bucket(x, quality.BUCKETS)[0])
    whole = [subword.features([w], quality.BUCKETS, quality.GRAMS) for w in words]
    ends = [
        subword.mix(
            subword.mix(
                np.array([int.from_bytes(w.encode()[-quality.ENDING :], "little")], np.uint64) + np.uint64(1)
            ) + np.uint64(2)
        ) for w in words
    ]
    for w, g, _ in whole:
        parts.append(model.vectors[[h(w), *g]].mean(axis=0))
    for i in range(1, len(words)):
        pair = [
            subword.mix(subword.mix(x[0] + np.uint64(of)) + x[1]) for x, of in (
                ((whole[i - 1][0], whole[i][0]), 3), ((ends[i - 1], ends[i]), 4)
            )
        ]
        parts.append(model.vectors[[quality.BUCKETS + int(subword.bucket(x, quality.PAIRS)[0]) for x in pair]].mean(axis=0))
    z = np.mean(parts, axis=0) @ model.weights + model.bias if parts else model.bias
    e = np.exp(z - z.max())
    return e[1] / e.sum()


def test_quality_scores_words_and_bigrams():
    model = quality.fit([(t, 1 - y) for t, y in toy(60, 5, shout)], epochs=2)
    group = ["", "one", "Tür Tür 日本 Tür", *[t for t, _ in toy(6, 6, shout)]]
    assert np.allclose(quality.Scorer(model).scores(group), [plain_quality(model, t) for t in group], atol=1e-4)


def test_quality_memory_is_bounded(monkeypatch):
    model = quality.fit([(t, 1 - y) for t, y in toy(60, 5, shout)], epochs=1)
    group = [t for t, _ in toy(40, 6, shout)]
    want = quality.Scorer(model).scores(group)
    monkeypatch.setattr(quality, "REMEMBERED", 50)
    small = quality.Scorer(model)
    assert np.allclose(np.concatenate([small.scores([t]) for t in group]), want, atol=1e-6)


@pytest.mark.parametrize(("module", "query", "label", "sf", "least"), [(toxicity, toxicity.op4_toxicity, "toxic", "sf0.1", (0.96, 0.8, 0.97)), (quality, quality.op10_quality_classifier, "quality", "sf0.1", (0.98, 0.97, 0.95))])
def test_held_out_accuracy(spark, module, query, label, sf, least):
    """Well above the larger class (0.88 toxic, 0.85 quality) and the best single word's log-odds (0.95 toxic), in each class."""
    sf = f"/root/testdata/{sf}"
    got = query(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    _, mod, rest = module.FOLD
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    share = lambda part: sum(r.predicted == r[label] for r in part) / len(part)
    figures = share(held), share([r for r in held if r[label] == 1]), share([r for r in held if r[label] == 0])
    print(module.__name__, figures)
    assert all(a >= b for a, b in zip(figures, least))


def test_driver_gives_memory_back(spark, monkeypatch):
    from lectio.llm import common, ngram_join

    called, real = [], common.give_back
    monkeypatch.setattr(common, "GIVE_BACK_S", 0)
    monkeypatch.setattr(common, "give_back", lambda s: called.append(real(s)))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(8)], "doc_id long, text string")
    assert ngram_join.keep_one(docs).count() == 4
    assert len(called) > 2
    monkeypatch.setattr(common, "GIVE_BACK_S", 1000)
    assert not real(spark)  # just done
