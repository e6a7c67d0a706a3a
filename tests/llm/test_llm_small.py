"""Small fixtures with nulls, empty texts, ties, repeats and clashing columns, held against brute force."""

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import ann, common, hamming, linededup, packing, pieces, sharding, simhash, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, h1 long, line string"


def documents(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "x") for i, t in zip(ids, texts)], DOCS)


def word_text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = "\n".join(word_text(rng, 12) for _ in range(300))
    texts = ["", None, " \n\t ", "one", "one two three four", "One two three four", long, long, long + " more", "é́ ﬁ 漢字 😀 a<|endoftext|>b", "x" * 9000]
    ids = [5, 3, 9, 1, 2, 7, 11, 10, 12, None, 13]
    rows = documents(spark, texts, ids)
    return rows.union(rows.where("doc_id = 10"))


# --- components ---------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(None, 1), (7, 7)] + [(900, i) for i in range(901, 1300)]
    found = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    reach = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            reach[a].add(b)
            reach[b].add(a)
    for start in reach:
        seen, todo = {start}, [start]
        while todo:
            for y in reach[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert found[start] == min(seen)
    assert set(found) == set(reach)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3: sharding --------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    own = {(r["doc_id"]): r["text"] for r in odd.collect()}
    for r in rows:
        raw = (own[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_tree_moves_rows_into_changed_subtrees_only(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    tree = sharding.standard_tree(24)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    both = sharding.assign(sharding.assign(rows, "k", tree, "a"), "k", heavier, "b").collect()
    moved = [r for r in both if r["a"] != r["b"]]
    assert moved and all(r["b"] // 8 == 0 for r in moved)
    counts = np.bincount([r["a"] for r in both], minlength=24)
    assert counts.min() > 100 and counts.max() < 240


# --- 2: SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])


def brute_components(fps):
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            parent[find(int(j))] = find(i)
    return {int(f): find(i) for i, f in enumerate(fps)}


@pytest.mark.parametrize("bits,hot", [(None, 2_000_000), (6, 90_000), (4, 40_000)])
def test_ball_links(spark, bits, hot):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(120):  # a hot ball, chains, and pairs at the edge of the radius
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        fps.add(x)
    frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.ball_links(frame, bits, hot).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    brute = brute_components(fps)
    assert len({(brute[f], find(f)) for f in fps}) == len(set(brute.values())) == len({find(f) for f in fps})


def test_near_duplicates(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    own = {r["doc_id"]: r for r in rows}
    assert {own[i]["component_id"] for i in (5, 3, 9)} == {3} and own[3]["fingerprint"] == "0" * 16
    assert own[11]["component_id"] == own[10]["component_id"] == own[12]["component_id"] == 10
    assert own[2]["component_id"] == own[7]["component_id"] == 2
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 10, 13]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- 5: toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = word_text(rng, rng.randint(5, 60)).split()
        if toxic:
            for w in rng.sample(["rotten", "vermin", "filth"], rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    texts += ["", None, "x" * 50_000]
    docs = documents(spark, texts)
    marks = spark.createDataFrame([*labels, (900, None, None), (5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, marks).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    wrong = [r for r in held if r["predicted"] != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 0.05 * len(held)
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 3
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert toxicity.toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0


def test_interactions_are_learned():
    rows = [(int(a and b), [0] * a + [1] * b + [2 + k % 3]) for k in range(400) for a in (0, 1) for b in (0, 1)]
    s = toxicity.Settings(keep=1.0, linear_epochs=10, epochs=60, factor_rate=0.05, factor_decay=0.0)
    bias, w, v = toxicity.train(rows, 5, s)
    machine = toxicity.Machine({}, bias, w, v)

    def z(at):
        x = v[at]
        return machine.bias + w[at].sum() + 0.5 * ((x.sum(axis=0) ** 2).sum() - (x**2).sum())

    assert z([0, 1, 2]) > 1 and z([0, 2]) < -1 and z([1, 2]) < -1


# --- 6: pieces ----------------------------------------------------------------------------------------------------------

tokenizers = pytest.importorskip("public_tokenizers")


def test_pieces_equal_the_library(spark, odd):
    from sentencepiece import SentencePieceProcessor

    path = tokenizers.path("piece_bpe_32k.model")
    library, table = SentencePieceProcessor(model_file=path), pieces.PieceTable(path, limit=50)
    rng = random.Random(2)
    texts = [r["text"] or "" for r in odd.collect()]
    texts += ["".join(rng.choice("ab the in an\n\t▁éß漢 😀<>/s0x\x00") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for t in texts:
        ids = library.encode(t)
        assert table.encode(t) == ids and table.decode(ids) == library.decode(ids)
        n, a, b = table.digest(t)
        assert n == len(ids) and a == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert b == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(4), 28705]) for _ in range(rng.randint(0, 6))]
        assert table.decode(ids) == library.decode(ids)
    assert pieces.digest_documents(odd, path).count() == odd.count()
    back = pieces.decode_documents(pieces.encode_documents(odd, path), path)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert pieces.digest_documents(odd.limit(0), path).count() == 0


# --- 9: packing ---------------------------------------------------------------------------------------------------------


def test_words_equal_the_library():
    path = tokenizers.path("word_bpe_49k.json")
    own = packing.WordCachedTokenizer(path, limit=40)
    rng = random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choice("aAbZéÉß .,'sStT\n\t019_-µ×漢ΣİŒ́<|") for _ in range(rng.randint(0, 25)))
        assert own.encode(t) == own.whole(t).tobytes()
    assert own.fast
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|", "'", "'s", "don't", " ", "\n", "café", "É", "a,b", "Σ", "ﬁ"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        assert own.encode(t) == own.whole(t).tobytes()


def test_long_chunks_take_linear_time():
    own = packing.WordCachedTokenizer(tokenizers.path("word_bpe_49k.json"))
    t = "a" * 5000 + "-" * 5000 + "'漢"
    assert own.encode(t) == own.whole(t).tobytes()


def test_a_file_that_cuts_words_otherwise_is_used_whole():
    other = packing.WordCachedTokenizer(tokenizers.path("word_bpe_49k.json"))
    plain = packing.SIMPLE_PARTS
    try:
        packing.SIMPLE_PARTS = r"[A-Za-z]|[0-9]"  # as a file would have it that cuts each letter apart
        other.__init__(tokenizers.path("word_bpe_49k.json"))
    finally:
        packing.SIMPLE_PARTS = plain
    assert not other.fast and other.encode("some words") == other.whole("some words").tobytes()


def test_packing(spark, odd):
    path = tokenizers.path("word_bpe_49k.json")
    own = packing.WordCachedTokenizer(path)
    rows = packing.pack(odd, path, window=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for r in odd.dropDuplicates(["doc_id"]).collect():
        ids = np.append(np.frombuffer(own.encode(r["text"] or ""), dtype="<u4"), 2).astype("<u4")
        at, copies = 0, 2 if r["doc_id"] == 10 else 1
        pieces_ = sorted({(p["start"], p["length"], p["ids_crc32"]) for p in by_doc[r["doc_id"]]})
        assert sum(p["length"] for p in by_doc[r["doc_id"]]) == copies * len(ids)
        for start, n, crc in pieces_:
            assert crc == zlib.crc32(ids[start : start + n].tobytes())
            assert copies == 2 or start == at
            at = start + n
        assert all(p["doc_tokens"] == len(ids) for p in by_doc[r["doc_id"]])
    for s in by_sequence.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:i]) for i in range(len(s))]
        total = sum(p["length"] for p in s)
        assert total <= 64 and total & (total - 1) == 0
    assert packing.pack(odd.limit(0), path).count() == 0


def test_sum_of_squares_picks_the_least():
    rng = random.Random(6)
    packer = packing.SumOfSquares(16)
    for i in range(400):
        n = rng.randint(1, 15)
        before = packer.count.copy()
        filled = packer.place((i, 0, n))
        options = []
        for h in [0, *range(1, 16)]:
            if h + n <= 16 and (h == 0 or before[h]):
                c = before.copy()
                if h:
                    c[h] -= 1
                if h + n < 16:
                    c[h + n] += 1
                options.append((c**2).sum())
        assert (packer.count**2).sum() == min(options)
        assert filled is None or sum(p[2] for p in filled) == 16


# --- 10: WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "é" * 60 + "\r\n\r\nx"
    data = [(4, "u", long), (2, "u", long), (9, "u\r\nz", "ab"), (8, None, "ab"), (7, "u", None), (6, "u", ""), (None, "u", long), (1, "u", "y" * 100)]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in data], "page_id long, url string, html string, digest string")
    rows = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(rows) == len(data)
    for i, _, h in data:
        raw = (h or "").encode()
        revisit = h == long and i != 2
        assert rows[i]["payload_bytes"] == len(raw) and rows[i]["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("revisit", 2) if revisit else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ranges_find_each_record_once(spark, tmp_path):
    rng = random.Random(8)
    raws = [warc.record("response", "u", f"urn:page:{i}", "d", rng.randbytes(rng.randint(0, 3000)), "00") for i in range(30)]
    nested = warc.member(warc.record("response", "u", "urn:page:99", "d", b"inner", "00"))
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = warc.record("response", "u", "urn:page:30", "d", nested * 4 + warc.MAGIC * 20, "00")
    blob = b"".join(map(warc.member, raws)) + z.compress(stored) + z.flush() + b"junk\x1f\x8b\x08" + warc.member(raws[0])
    (tmp_path / "a.warc.gz").write_bytes(blob)
    whole = [p for p, _, _ in warc.members(io.BytesIO(blob), 0, len(blob))]
    assert len(whole) == 32
    for size in (211, 4096, 10**7):
        files = warc.archives(spark, f"file://{tmp_path}")
        assert sorted(r["position"] for r in warc.read_archives(files, size).collect()) == whole


# --- 1 and 7: searches --------------------------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:300] = x[100]  # a common vector
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, []), (None, data[0][1])]
    frame = spark.createDataFrame([*data, *bad, data[0]], "vec_id long, embedding array<float>")
    rows = ann.search(frame, top=20, shard_rows=300).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    assert set(by) == set(range(0, 900, 20))
    hit = 0
    for q, found in by.items():
        s = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in found)
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys) and q not in {r["vec_id"] for r in found}
        hit += len(set(order) & {r["vec_id"] for r in found})
    assert hit >= 0.95 * 20 * len(by)
    assert ann.search(frame.limit(0)).count() == 0
    few = ann.search(spark.createDataFrame(data[:3], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 1), (0, 2)]


def test_hamming_search_is_exact(spark):
    rng = random.Random(11)
    codes = [rng.getrandbits(64) for _ in range(150)]
    codes += [codes[0] ^ (1 << rng.randrange(64)) for _ in range(60)] + [codes[1]] * 80
    signed = [(i * 10, c - (1 << 64) if c >= 1 << 63 else c) for i, c in enumerate(codes)]
    frame = spark.createDataFrame([*signed, signed[0], (None, 1), (7, None)], "vec_id long, code long")
    rows = hamming.search(frame, top=5, step=100).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["distance"], r["vec_id"]))
    for q in range(0, len(codes) * 10, 100):
        brute = sorted((bin(c ^ codes[q // 10]).count("1"), i * 10) for i, c in enumerate(codes) if i * 10 != q)[:5]
        assert found[q] == brute
    assert hamming.search(frame.limit(0)).count() == 0


# --- 8: line dedup ------------------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits,hot", [(1, 32), (1, 2), (2, 32), (2, 6)])
def test_line_classes(spark, edits, hot):
    rng = random.Random(13)
    base = [word_text(rng, 6)[:30].ljust(26, "q") for _ in range(25)]
    texts = []
    for _ in range(40):
        own = []
        for _ in range(rng.randint(0, 4)):
            line = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(line))
                line = rng.choice([line[:k] + line[k + 1 :], line[:k] + "é" + line[k:], line[:k] + "z" + line[k + 1 :]])
            own.append(rng.choice(["", "  "]) + line)
        texts.append("\n".join([*own, "short", ""]))
    docs = documents(spark, [*texts, None, "", "x" * 20_000])
    rows = linededup.line_classes(docs, max_edits=edits, min_chars=20, hot=hot).collect()
    lines = {(d, i): x.strip(" ") for d, t in enumerate([*texts, "", "", "x" * 20_000]) for i, x in enumerate(t.split("\n")) if x.strip(" ")}
    assert len(rows) == len(lines)
    distinct = sorted(set(lines.values()))
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= edits and edit(a, b) <= edits:
                parent[find(a)] = find(b)
    first = {}
    for at, x in sorted(lines.items()):
        first.setdefault(find(x), at)
    for r in rows:
        head = first[find(lines[r["doc_id"], r["line_no"]])]
        assert (r["class_doc_id"], r["class_line_no"]) == head and r["kept"] == (head == (r["doc_id"], r["line_no"]))


def test_dedup_lines(spark):
    line = "a line that is long enough to take part"
    docs = documents(spark, [f"{line}\nnew", f"x\n{line}.\ny\n{line}", None, ""], [4, 6, 1, None])
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert out[4]["text"] == f"{line}\nnew" and out[6]["text"] == "x\ny" and out[6]["n_chars"] == 3
    assert out[1]["text"] is None and out[None]["text"] == ""
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert linededup.line_classes(docs.limit(0)).count() == 0


# --- 4: URL filters -----------------------------------------------------------------------------------------------------


def test_temporal_list(spark):
    entries = [("example.org", "block", "2024-01-10", "add"), ("example.org", "block", "2024-02-10", "remove"), ("example.org", "block", "2024-02-10", "remove"),
               ("good.example.org", "allow", "2024-01-20", "add"), ("bad.net", "block", "2024-01-01", "add"), ("bad.net", "block", "2024-01-05", "add"),
               (None, "block", "2024-01-01", "add"), ("x.y", "block", None, "add"), ("x.y", "block", "2024-01-01", "odd")]
    captures = [(1, "http://www.example.org/a", "2024-01-09", "none"), (2, "http://www.Example.org:80/a", "2024-01-10", "block"),
                (3, "https://u@good.example.org./", "2024-01-19", "block"), (4, "https://good.example.org/", "2024-01-20", "allow"),
                (5, "http://example.org", "2024-02-10", "none"), (6, "http://a.bad.net?q", "2024-01-05", "block"), (7, None, "2024-01-05", "none"),
                (8, "no url", "2024-01-05", "none"), (9, "http://bad.net", None, "none"), (None, "http://bad.net", "2024-01-02", "block"), (6, "http://a.bad.net?q", "2024-01-05", "block")]
    frame = spark.createDataFrame([(i, u, d, "clash") for i, u, d, _ in captures], "page_id long, url string, fetched string, pattern string")
    rows = urlfilter.judge(frame, spark.createDataFrame(entries, "pattern string, list string, day string, action string")).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in rows) == sorted((i or 0, v) for i, _, _, v in captures)
    assert next(r for r in rows if r["page_id"] == 6)["valid_from"].isoformat() == "2024-01-05"
    none = spark.createDataFrame([], "pattern string, list string, day string, action string")
    assert urlfilter.judge(frame, none).where("verdict = 'none'").count() == len(captures)
    assert urlfilter.judge(frame.limit(0), none).count() == 0
