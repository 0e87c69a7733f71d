"""The exact operators against brute force, on random small corpora and the defined cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, exchange, graph, near_dedup, substring_dedup, suffix_dedup, textkit

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, part int, id string, payload string"  # columns with clashing names


def corpus(seed, n=60, passages=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abÉ中") for _ in range(r.randint(1, 3)))
    shared = [[word() for _ in range(r.randint(10, 40))] for _ in range(passages)]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            a = r.randint(0, len(p) - 1)
            w += p[a:] if r.random() < 0.5 else [word() for _ in range(r.randint(1, 30))]
        if r.random() < 0.2 and out:
            w = out[-1][1].split() if out[-1][1] else w
        sep = r.choice([" ", "  ", "\n", "\t\x0b"])
        out.append((i * 3, sep.join(w)))
    out += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, " ".join(["x y"] * 400)), (1005, "\x00\x1cA￿b"), (None, out[5][1]), out[3], out[3]]
    r.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA).repartition(5)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("seed,n,base", [(0, 13, 7), (1, 13, 3), (2, 8, 8), (3, 20, 4)])
def test_substring(spark, seed, n, base):
    rows = corpus(seed)
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - n + 1):
                x = tuple(w[k : k + n])
                first[x] = min(first.get(x, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = True
        want.append((i, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    got = substring_dedup.remove_repeats(frame(spark, rows), words=n, base=base).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(x[2] for x in want) > 0
    cut = substring_dedup.cut(frame(spark, rows), words=n, base=base)
    assert cut.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    kept = Counter((r["doc_id"], sha(" ".join(words(r["text"])).encode())) for r in cut.collect())
    assert kept == Counter((x[0], x[3]) for x in want)


@pytest.mark.parametrize("n,base", [(13, 4), (8, 8)])
def test_substring_in_pieces(spark, monkeypatch, n, base):
    """Texts that are cut into many pieces give what whole ones give."""
    rows = corpus(4, 30)
    r = random.Random(4)
    long = " ".join(r.choice(["aa", "b", "ccc", "dé", "q" * 700]) for _ in range(900))
    rows += [(2000, long), (2001, " x " + long[700:3000] + "  " + long), (2002, "z" * 5000), (2003, " " * 5000 + "end"), (2004, " " * 3000 + long[:900] + " " * 3000)]
    whole = substring_dedup._finish(n), substring_dedup._cut(n)
    import pyarrow as pa

    docs = pa.table({"part": pa.array([0] * len(rows), pa.int32()), "id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "row": pa.array(list(range(len(rows))))})

    def result():
        replies, prior = None, 0
        for length in substring_dedup.lengths(n, base):
            run = substring_dedup._entries(prior, length, n, 3)
            entries = run(docs) if replies is None else run(docs, replies)
            found = [substring_dedup._repeated(1 if length < n else 2)(entries.filter(pa.compute.equal(entries.column("part"), b))) for b in range(3)]
            replies, prior = pa.concat_tables(found), length
        return whole[0](docs, replies), whole[1](docs, replies)

    a = result()
    assert sum(a[0].column("n_removed").to_pylist()) > 100
    monkeypatch.setattr(textkit, "CHUNK", 300)
    b = result()
    assert a[0].equals(b[0]) and a[1].equals(b[1])


def test_a_hot_window_is_one_entry_of_a_shard():
    import pyarrow as pa

    hot = " ".join(f"w{i}" for i in range(20))
    docs = pa.table({"part": pa.array([5] * 400, pa.int32()), "id": pa.array(range(400), pa.int64()), "text": pa.array([f"{hot} own{i}" for i in range(400)])})
    for prior, length, n in ((0, 4, 1), (0, 13, 2)):
        told = substring_dedup._entries(prior, length, 13, 1)(docs)
        h, *_, least, several, shard = exchange.get_all(told.column("payload").to_pylist(), n + 3)
        assert len(h) <= 400 + 8 and set(shard.tolist()) == {5}
        assert sorted(least[several > 0].tolist()) == [0] * int((several > 0).sum())


def test_cut_leaves_other_texts(spark):
    assert [r["doc_id"] for r in substring_dedup.cut(frame(spark, [(1, "q " * 20), (2, "q " * 20), (3, ""), (4, None)]), emptied=False).orderBy("doc_id").collect()] == [1, 3, 4]
    rows = [(1, "a  b\nc"), (2, None), (3, "x " + " ".join(f"w{i}" for i in range(20)) + "\n  end"), (4, " y  " + " ".join(f"w{i}" for i in range(20)) + "\n z ")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.cut(frame(spark, rows)).collect()}
    assert got == {1: "a  b\nc", 2: None, 3: rows[2][1], 4: " y  z"}


@pytest.mark.parametrize("seed,length,batches,local,large", [(0, 64, 1, 64, 256), (1, 64, 3, 64, 256), (2, 70, 5, 1, 256), (3, 200, 4, 64, 1), (4, 64, 4, 0, 1), (5, 64, 3, 2, 3)])
def test_suffix(spark, monkeypatch, seed, length, batches, local, large):
    monkeypatch.setattr(suffix_dedup, "LOCAL", local)
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rows = corpus(seed, 40)
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    want = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows), length, batches).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(x[2] for x in want) > 0


def test_suffix_unique_ids_and_long_text(spark, monkeypatch):
    r = random.Random(5)
    long = "".join(r.choice("abcdef ") for _ in range(9000))
    rows = [(1, long), (2, "q" * 150 + long[4000:4300]), (3, "z" * 500), (4, "nothing here")]
    monkeypatch.setattr(textkit, "CHUNK", 1 << 10)
    direct = suffix_dedup.suffixes([long.encode()], 200)
    monkeypatch.undo()
    whole = suffix_dedup.suffixes([long.encode()], 200)
    covered = lambda s: sorted(x for p, n in zip(s[-2], s[-1]) for x in range(p, p + n))
    assert covered(direct) == covered(whole) == list(range(len(long) - 199))  # each string has one run, in pieces or whole
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeated_bytes(frame(spark, rows), 200, 2).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"], got[3]["n_spans"], got[4]["n_removed"]) == (300, 300, 500, 1, 0)


def test_index_family_levels(spark):
    family = suffix_dedup.IndexFamily(spark, 4, 4)
    docs = frame(spark, [(i, "common passage " * 10 + str(i) * 40) for i in range(12)]).select(F.col("doc_id").alias("id"), "text")
    arrays = docs.mapInArrow(suffix_dedup._array_of(64, 4, 4, 5, 64), suffix_dedup._ARRAYS).where(f"kind = {suffix_dedup.ARRAY}").cache()
    sizes = []
    for b in range(5):
        family.add(arrays.where(F.col("batch") == b).select("part", "payload"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    for row in family.levels[0][1].collect():
        cols = exchange.get(row["payload"])
        assert len(cols) == suffix_dedup.KEYS + 3 and list(zip(*cols[:4])) == sorted(zip(*cols[:4]))


def test_suffixes_are_in_byte_order():
    r = random.Random(2)
    text = "".join(r.choice("abc ") for _ in range(5000)).encode()
    head, *_, place, _ = suffix_dedup.suffixes([text], 100)
    firsts = [int(h).to_bytes(8, "big") for h in np.sort(head)]
    assert firsts == sorted(firsts) and all(f in text for f in firsts) and len(firsts) > 50


@pytest.mark.parametrize("large", [256, 1])
def test_index_opened_again(spark, tmp_path, monkeypatch, large):
    """Batches that are added to a stored family one by one, against brute force over all that is there."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    r = random.Random(7)
    shared = ["".join(r.choice("abcd ") for _ in range(r.randint(70, 200))) for _ in range(4)]
    texts = ["".join(r.choice(shared) if r.random() < 0.6 else "".join(r.choice("efgh ") for _ in range(r.randint(5, 60))) for _ in range(r.randint(0, 4))) for _ in range(40)]
    rows = list(enumerate(texts))
    make = lambda part: spark.createDataFrame(part, "id long, text string").repartition(3)
    covered = {i: np.zeros(len(t), bool) for i, t in rows}
    for k, (a, b) in enumerate([(0, 15), (15, 16), (16, 30), (30, 40)]):
        family = suffix_dedup.IndexFamily(spark, 3, 5, 64) if k == 0 else suffix_dedup.IndexFamily.open(spark, f"{tmp_path}/index")
        for x in family.add_documents(make(rows[a:b]), make(rows[:b])).collect():
            covered[x["id"]][x["start"] : x["start"] + x["size"]] = True
        family.save(f"{tmp_path}/index")
        count = Counter(t[j : j + 64] for t in texts[:b] for j in range(len(t) - 63))
        for i, t in rows[:b]:
            want = np.zeros(len(t), bool)
            for j in range(len(t) - 63):
                if count[t[j : j + 64]] > 1:
                    want[j : j + 64] = True
            assert (covered[i] == want).all()
    assert sum(c.sum() for c in covered.values()) > 1000


@pytest.mark.parametrize("seed,together", [(0, 4), (1, 1)])
def test_decontaminate(spark, monkeypatch, seed, together):
    if together == 1:  # several passes
        monkeypatch.setattr(decontaminate, "TOGETHER", 1)
        monkeypatch.setattr(decontaminate, "BLOCK", 400)
    rows = corpus(seed)
    r = random.Random(seed)
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = []
    for k in range(12):
        w = words(r.choice(rows)[1])
        items.append((str(k), " , ".join(w[: r.randint(0, 25)]).upper()))
    items += [("a", None), (None, "x y"), ("b", "--"), ("3", items[3][1])]
    hits = {}
    bench = [(i, tok(t)) for i, t in items if tok(t)]  # an item without an id hits, but is not named
    want = []
    for i, t in rows:
        w = tok(t)
        gone, found = np.zeros(len(w), bool), set()
        for name, b in bench:
            n = min(10, len(b))
            own = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    gone[k : k + n] = True
                    found |= {name} - {None}
        want.append((i, len(w), int(gone.sum()), len(found), sha(",".join(sorted(found)).encode()), bool(gone.any())))
    hits = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(frame(spark, rows), hits).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    clean = decontaminate.clean(frame(spark, rows), hits)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(x for x, w in zip(rows, want) if not w[5])
    blocks = list(decontaminate.blocks(hits, block=200))
    assert len(blocks) > 1 and sum(len(b.names) for b in blocks) == 15
    nothing = decontaminate.contamination(frame(spark, rows), hits.limit(0)).collect()
    assert all(x["n_hit"] == 0 for x in nothing)


def test_decontaminate_in_pieces(monkeypatch):
    r = random.Random(8)
    bench = [(str(k), " ".join(r.choice("ab cd ef gh".split()) + str(r.randint(0, 5)) for _ in range(r.choice([3, 12, 30])))) for k in range(20)]
    text = " ".join(x for k in range(60) for x in (bench[r.randrange(20)][1], "- " * r.randint(0, 300), f"Q{k}")).encode()
    texts = [b"", text, b"ab1 cd2", b"--- " * 500, bench[0][1].encode()]
    index = [decontaminate.Index(bench[:10]), decontaminate.Index(bench[10:])]
    whole = list(decontaminate._judge(index, texts, 10))
    monkeypatch.setattr(textkit, "CHUNK", 200)
    cut = list(decontaminate._judge(index, texts, 10))
    assert [(m.tolist(), names) for m, names in whole] == [(m.tolist(), names) for m, names in cut] and whole[1][0].sum() > 100


def brute_near(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is not None and find(i) == i) for (i, _), s in zip(rows, sets)]


def mutated(seed, n):
    """A family of near copies with every kind of distance, and others."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [f"v{r.randint(0, 300)}" for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"w{r.randint(0, 8)}"
        rows.append((i * 2, " ".join(w).upper() if i % 5 == 0 else " \n".join(w)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one"), (None, rows[1][1]), rows[4], rows[4]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent,small", [(0, 3, 85, 24), (1, 3, 85, 2), (2, 5, 80, 2)])
def test_near_dedup(spark, monkeypatch, seed, k, percent, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    if small == 2:  # large buckets in blocks, and keys that are dealt to several tasks
        monkeypatch.setattr(near_dedup, "BLOCK", 5)
        monkeypatch.setattr(near_dedup, "OTHERS", 7)
        monkeypatch.setattr(graph, "HOT", 3)
    rows = mutated(seed, 90)
    got = near_dedup.near_duplicates(frame(spark, rows), k, percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_near(rows, k, percent))


def test_shingles_in_pieces(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "Bb", "cé", "d" * 90]) for _ in range(n)).encode() for n in (800, 3, 2, 1)] + [b"", b" " * 900, b"x" * 900, b" " * 400 + b"p Q" + b" " * 400]
    whole = [near_dedup.text_sets([t], 3)[0].tolist() for t in texts]
    monkeypatch.setattr(textkit, "CHUNK", 100)
    assert [near_dedup.text_sets([t], 3)[0].tolist() for t in texts] == whole
    assert [len(x) for x in whole[3:]] == [1, 0, 0, 1, 1]


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([("a", "b c")], "item_id string, text string")).count() == 0


def test_shards_match_spark(spark):
    ids = np.array([0, 1, -1, 5, 2**40, -(2**50), 2**63 - 1], np.int64)
    df = spark.createDataFrame([(int(i),) for i in ids], "doc_id long").select("doc_id", exchange.shard_column(97).alias("p"))
    assert {r["doc_id"]: r["p"] for r in df.collect()} == dict(zip(ids.tolist(), exchange.shard_of(ids, 97).tolist()))


def test_packing():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 100).astype(np.uint64), r.integers(-50, 50, 100)
    x, y = exchange.get(exchange.put([a, b]))
    assert (x == a).all() and (y.view(np.int64) == b).all()
    assert [len(c) for c in exchange.get(exchange.put([a[:0], b[:0]]))] == [0, 0]


def thue_morse(n=1024):
    """A word over a and b and its complement, which polynomials modulo 2**64 cannot tell apart."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_different_long_words_are_different(spark):
    a, b = thue_morse()
    own = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*own, a])), (2, " ".join([*own, b])), (3, " ".join([*own, a])), (4, a), (5, b), (6, f"x y {a}"), (7, f"x y {b}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0, 6: 0, 7: 0}
    linked = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert linked[4] == 4 and linked[5] == 5 and linked[6] == 6 and linked[7] == 7 and linked[3] == 1
