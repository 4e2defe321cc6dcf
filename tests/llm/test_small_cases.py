"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pairloom.llm import bpe, chat, graph_search, jaccard, linking, mixing, paragraphs, pii, queries, secret_scan, toxicity
from pairloom.llm.spans import text_form

WORDS = "ape bee cat dog eel fox gnu hen ibis jay kite lark mole newt owl pig quail rat seal toad".split()


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case; the extra columns have names that operators use themselves."""
    rows = [(1, "hello", "a", 5), (2, None, None, None), (3, "", "b", 0), (None, "hello", "a", 5), (4, "word " * 20_000, "a", 100_000), (4, "word " * 20_000, "a", 100_000), (5, "\t\n ", "c", 3)]
    rows = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, root string, s long, size string")


def components(rows, percent=80):
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies():
    rng, rows = random.Random(3), []
    for g in range(12):
        base = sentence(g, rng.randrange(4, 120)).split()
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(words)))
    return rows + [(1, ""), (2, "   "), (3, "One two"), (4, "one\ttwo")]


@pytest.mark.parametrize("block,long", [(2048, 64), (3, 64), (2048, 2)])
def test_join_equals_brute_force(spark, monkeypatch, block, long):
    monkeypatch.setattr(jaccard, "blocked", lambda m, s: linking.blocked(m, s, block))
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if long != 64:
        monkeypatch.setattr(jaccard, "LONG", long)
    got = jaccard.ngram_join(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows)


def test_link_finds_every_component():
    import numpy as np

    rng = np.random.default_rng(0)
    for trial in range(20):
        base = rng.integers(0, 10**6, 60, dtype=np.uint64)
        sets = []
        for _ in range(40):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 25))] = rng.integers(10**6, 10**7, 1, dtype=np.uint64)[0] + np.uint64(trial)
            sets.append(np.unique(own))
        roots, *_ = linking.link(sets, [0.0] * len(sets), 80)
        up = list(range(len(sets)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
        assert [[roots[i] == roots[j] for j in range(40)] for i in range(40)] == [[root(i) == root(j) for j in range(40)] for i in range(40)]


def test_leaders_that_do_not_merge_end(spark, monkeypatch):
    import numpy as np

    rounds, plain = [], linking._round
    monkeypatch.setattr(linking, "_round", lambda *a: plain(*a) if rounds.append(a) or len(rounds) < 8 else pytest.fail("no end"))
    common = np.arange(20, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, 1000 * np.uint64(i + 1) + np.arange(20, dtype=np.uint64)])) for i in range(24)]  # Jaccard 1/3
    sets += [np.sort(np.append(s[:-1], np.uint64(10**6 + i))) for i, s in enumerate(sets[:6])]  # near copies, in any block
    names = [bytes([i]) for i in range(len(sets))]
    rows = spark.createDataFrame([(g, bytearray(n if g == 1 else n + b"x"), bytearray(s.tobytes())) for n, s in zip(names, sets) for g in (1, 2) if g == 1 or n < b"\x02"], "grp long, item binary, items binary")
    sizes = rows.groupBy("grp").agg(F.count("item").alias("n"), F.sum(F.length("items") / 8).alias("m"))
    space = linking.Workspace(spark, "test")
    got = linking.link_groups(space, linking.blocked(rows, sizes, 100, 200), 80, True, 100, 200).collect()
    root = {bytes(r.item): bytes(r.root) for r in got}
    assert len(root) == len(sets) + 2
    for i in range(len(sets)):
        for j in range(i):
            assert (root[names[i]] == root[names[j]]) == (i - j == 24)


def test_join_keeps_one_of_each_group(spark, odd):
    found = jaccard.ngram_join(odd)
    assert found.count() == 7
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert jaccard.keep_one(odd.limit(0)).count() == 0


def test_repeated_passages(spark, odd):
    passage = ". ".join(sentence(i, 14) for i in range(5)) + "."
    rows = [(10, sentence(50, 40) + " " + passage + " " + sentence(51, 40)), (11, sentence(52, 9) + ". " + passage + "\n" + sentence(53, 30)), (12, sentence(54, 200)), (13, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_passages(docs)
    got = found.collect()
    assert {r.doc_id for r in got} == {10, 11, 13} and {r.doc_id for r in got if r.removed} == {11, 13}
    clean = {r.doc_id: r.text for r in paragraphs.without(docs, found).collect()}
    assert clean[12] == rows[2][1] and clean[10] == rows[0][1] and len(clean[11]) < len(rows[1][1]) - 100
    assert paragraphs.repeated_passages(odd).count() >= 0 and paragraphs.repeated_passages(odd.limit(0)).count() == 0
    bands, size = paragraphs.tune(0.8, 0.999)
    assert 1 - (1 - 0.8**size) ** bands >= 0.999


def test_passages_without_punctuation(spark):
    plain, cut = sentence(1, 60), ("é " + sentence(2, 22) + ". " + sentence(3, 35)).split()
    reflowed = sentence(4, 60).split()
    rows = [(1, sentence(10, 90) + " " + plain + " " + sentence(11, 90)), (2, "é " + sentence(12, 70) + " " + plain + " " + sentence(13, 120)),
            (3, sentence(14, 9) + " " + " ".join(cut) + " " + sentence(15, 9) + ". " + sentence(16, 30)), (4, sentence(17, 15) + " " + " ".join(cut) + " " + sentence(18, 12) + "."),
            (5, " ".join(reflowed)), (6, "\n".join(" ".join(reflowed[i : i + 7]) for i in range(0, 60, 7))), (7, sentence(19, 300))]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.removed) for r in found} == {(1, False), (2, True), (3, False), (4, True), (5, False), (6, True)}
    text, whole = dict(rows), {1: plain, 2: plain, 3: " ".join(cut), 4: " ".join(cut), 5: " ".join(reflowed), 6: " ".join(reflowed)}
    for r in found:
        own = " ".join(text[r.doc_id][r.start : r.end].split())
        assert own in whole[r.doc_id] and len(own.split()) == r.words >= 20


def test_near_copied_and_short_sentences(spark):
    def edited(words, at):
        return " ".join([*words[:at], "other", *words[at + 1 :]])

    last, middle = sentence(1, 30).split(), sentence(2, 55).split()
    short = ". ".join(sentence(30 + i, 3) for i in range(10)) + "."
    pairs = [(" ".join(last) + ".", edited(last, 29) + "."), (" ".join(middle) + ".", edited(middle, 27) + "."), (short, short)]
    rows = [(2 * i + j, f"{sentence(50 + 2 * i + j, 40)}. {x} {sentence(70 + 2 * i + j, 40)}.") for i, two in enumerate(pairs) for j, x in enumerate(two)]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, rows[r.doc_id][1][r.start : r.end], r.words, r.removed) for r in found}
    assert got == {(2 * i + j, x, len(x.split()), bool(j)) for i, two in enumerate(pairs) for j, x in enumerate(two)}


def test_toxicity(spark, odd):
    rows = [(i, sentence(i, 30) + (" vile" + "abcdefgh"[i % 8] + "scum" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, usable=~toxicity.held_out("id"))
    scored = toxicity.score(docs.withColumn("score", F.lit("old")), model).withColumn("held", toxicity.held_out()).where("held").collect()
    assert scored and sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in scored) >= 0.97 * len(scored)
    assert toxicity.score(odd, model).count() == 7
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}


def test_personal_data(spark, odd):
    assert pii.annotate(odd, pii.fit(odd)).count() == 7
    text = "é mail a.b@c-d.org or card 4111-1111-1111-1111, host 8.8.8.8, call +1 (229) 555-4838 x 999.1.1.1"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.annotate(docs, pii.fit(docs)).select(text_form(F.col("base")).alias("base")).first()
    assert row.base == "email:7:18,card:27:46,ip:53:60,phone:67:84"
    long = spark.createDataFrame([(1, "1 " * 50_000 + "a" * 100_000 + "1.1." * 20_000 + "+" * 1000)], "doc_id long, text string")
    assert pii.annotate(long, pii.fit(docs)).count() == 1
    assert pii.annotate(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_secrets(spark, odd):
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == 7
    rows = [(1, "user = bob99 password=abc1234"), (2, "ABCDEFGH12345678 only"), (3, "id ABCDEFGH12345678 key Qx7" + "aB3d" * 6), (4, "x" * 300 + " ABCDEFGH12345678 " + "y " * 400 + 'token = "0123456789abcdef0123"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in secret_scan.find_secrets(docs).select("doc_id", text_form(F.col("base")).alias("base"), text_form(F.col("spans")).alias("spans")).collect()}
    assert got[1] == ("", "access:0:12,assign:13:29") and got[2] == ("", "")
    assert got[3] == ("", "access:3:19,token:24:51") and got[4][0] == got[4][1] != ""
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}[1] == "[access] [assign]"


def test_graph_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)] + [(1000 + i, [1.0] * 16) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, [1.0] * 16), (2050, [1.0, 2.0]), (2051, [2.0, 4.0]), (5, rows[5][1])]
    found = graph_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    unit = {}
    for i, v in rows[:640]:
        n = sum(x * x for x in v) ** 0.5
        unit[i] = [x / n for x in v]
    hit = total = 0
    for q in [i for i in unit if i % 50 == 0]:
        score = {i: sum(a * b for a, b in zip(unit[q], v)) for i, v in unit.items() if i != q}
        fifth = sorted(score.values())[-5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert len(mine) == 5 and q not in [m[1] for m in mine]
        hit, total = hit + sum(m[2] >= fifth - 1e-9 for m in mine), total + 5
    assert hit / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 1000), key=lambda r: r.rank)] == [1001, 1002, 1003, 1004, 1005]
    assert [r.vec_id for r in found if r.query_id == 2050] == [2051]
    assert graph_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


def test_secrets_link_by_their_gap(spark):
    long, name, site = "aB3dEfGh" * 200, "ABCDEFGH12345678", "https://x.org/a"
    rows, far = [], secret_scan.SCOPE
    for shift in (0, 1, 100, 255):
        for gap in (1, 200, far - 1, far, far + 1, 900):
            for left, right in ((name, long), (long, name), (long, site), (site, long), (name, "token=abc1234")):
                rows.append((len(rows), ". " * (shift // 2) + " " * (shift % 2) + left + " " * gap + right, shift, gap, left, right))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs).select("doc_id", text_form(F.col("spans")).alias("spans")).collect()}
    for i, _, shift, gap, left, right in rows:
        kind = {name: "access", long: "token", site: ""}
        at = [(kind.get(left, "assign"), shift, shift + len(left)), (kind.get(right, "assign"), shift + len(left) + gap, shift + len(left) + gap + len(right))]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in at if k and gap <= far), rows[i][2:4]


def test_recall_in_a_full_shard():
    import numpy as np

    rng = np.random.default_rng(7)
    x, q = (graph_search._unit(rng.normal(size=(n, 64))) for n in (graph_search.SHARD, 200))
    graph, entry = graph_search.build(x)
    found, _ = graph_search._beam(x, graph, entry, q, graph_search.QUERY_BEAM)
    true = np.argsort(-(q @ x.T), 1)[:, :5]
    assert sum(len(set(a[:5]) & set(b)) for a, b in zip(found.tolist(), true.tolist())) >= 0.98 * true.size


def test_mixing(spark, odd):
    mixed = mixing.mix(odd)
    assert mixed.count() == 7 and {"root", "s"} <= set(mixed.columns)
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= 9 and r.target <= 3 * r.size
    assert sum(r.target for r in out) == pytest.approx(sum(r["size"] for r in out))
    less, more = (mixing.mix(docs, share=x).where("copies > 0") for x in (0.3, 0.6))
    assert less.select("doc_id").subtract(more.select("doc_id")).count() == 0
    assert mixing.repeat(mixing.mix(docs)).agg(F.sum("size")).first()[0] == sum(r.taken for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_bpe_equals_tiktoken(spark, odd):
    codec = bpe.Codec.from_file(queries.vocabulary(), public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(), "rb"))}
    assert all(codec.whole(k) == v for k, v in ranks.items()) and codec.whole(b"\xff\xfe\xfd no") == -1
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x500), rng.randrange(0x2000, 0x3100), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["a" * 5000, "\x1c \x1d", "²½Ⅷ a²b", "<|endoftext|>", "x" * 1000 + "é" * 1000]
    for t in texts:
        assert list(bpe.unpack(codec.encode(t))) == other.encode_ordinary(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, codec), codec)
    assert back.where(F.col("decoded") != F.encode("text", "UTF-8")).count() == 0
    assert {r.doc_id: list(r.ids) for r in back.collect()} == {i: other.encode_ordinary(t) for i, t in enumerate(texts)}
    with pytest.raises(KeyError):
        codec.decode([b"\xff\xff\xff\x00"])
    assert bpe.encode(odd, codec).where("n_tokens = 0").count() == 2


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "é"), (1, None, None, None), (None, 0, "bob", "x"), (2, 0, "system", "only"), (3, 5000, "user", "late"), (3, 1, "user", "early"), (3, 1, "user", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.participant, r.part): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "user", 0), (1, "assistant", 0), (1, "unknown", 0), (None, "bob", 0), (3, "user", 0), (3, "user", 4)}
    r = got[1, "assistant", 0]
    assert "<|im_start|>assistant\né<|im_end|>\n" in r.rendered and "user name=user\nhi <\\|im_end|\\>" in r.rendered
    a, b = map(int, r["mask"].split(":"))
    assert r.rendered[a:b] == "é<|im_end|>\n"
    assert got[3, "user", 4].start == len(got[3, "user", 0].rendered)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_graph_search_broadcasts_no_queries(spark):
    """A limit that holds the queries, but not their copies for all shards, must not make these go through the driver."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(7, x[7].tolist())], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = graph_search.nearest(rows, F.col("id") % 50 == 0)
        got = found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    d = x.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    np.fill_diagonal(cos, -2)
    want = {(q, int(v)) for q in range(0, 2000, 50) for v in np.argsort(-cos[q])[:5]}
    assert len(got) == 200 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.99 * 200
    assert all(abs(r.score - cos[r.query_id, r.vec_id]) < 1e-12 for r in got)


def dense_group(n):
    """Near copies of one set, of which those with few edits link and the others stay alone."""
    import numpy as np

    rng, base, sets = np.random.default_rng(4), np.arange(100, dtype=np.uint64), []
    for i in range(n):
        edits = int(rng.integers(0, 31))
        sets.append(np.sort(np.concatenate([rng.permutation(base)[edits:], np.uint64(1000 * (i + 1)) + np.arange(edits, dtype=np.uint64)])))
    return sets


def linked_in_groups(sets):
    import numpy as np

    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("wide", [64, 0])
def test_near_copies_of_several_blocks_meet_once(spark, monkeypatch, wide):
    """No pair of leaders brings all of its members' sets to a task, whether half blocks meet at once or after the rounds."""
    settled, plain = [], linking._settle
    monkeypatch.setattr(linking, "WIDE", wide)
    monkeypatch.setattr(linking, "_settle", lambda cells, percent: settled.append(cells.count()) or plain(cells, percent))
    sets = dense_group(120)
    names = [bytes([i]) for i in range(len(sets))]
    rows = spark.createDataFrame([(1, bytearray(n), bytearray(s.tobytes())) for n, s in zip(names, sets)], "grp long, item binary, items binary")
    sizes = rows.groupBy("grp").agg(F.count("item").alias("n"), F.sum(F.length("items") / 8).alias("m"))
    got = linking.link_groups(linking.Workspace(spark, "test"), linking.blocked(rows, sizes, 60, 10**6), 80, True, 60, 10**6).collect()
    label, plain_label = {bytes(r.item): bytes(r.root) for r in got}, linked_in_groups(sets)
    assert len(got) == len(sets) and sum(settled) == 0
    for i in range(len(sets)):
        for j in range(i):
            assert (label[names[i]] == label[names[j]]) == (plain_label[i] == plain_label[j])


def test_components_of_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(6)
    for trial in range(60):
        sets = []
        for _ in range(rng.integers(1, 4)):  # one near-copied text, or several, so that over half of the sets hold nothing
            base = rng.integers(0, 10**6, rng.integers(1, 60), dtype=np.uint64)
            for _ in range(rng.integers(1, 20)):
                own, m = base.copy(), rng.integers(0, len(base) // 3 + 1)
                own[rng.integers(0, len(base), m)] = rng.integers(10**6, 10**6 + (3, 30, 10**6)[trial % 3], m, dtype=np.uint64)
                sets.append(np.unique(own[: len(own) - rng.integers(0, len(own) // 6 + 1)]))
        assert linking.components_of(sets, 80).tolist() == linked_in_groups(sets)


def test_lists_that_counters_cannot_tell_from_chance_are_paired_up():
    """A shingle of 120 unlike texts among counters of 430 each: chained it would join all of them to one group."""
    import numpy as np

    counts = np.full(jaccard.CELLS, 430)
    counts[::1000] += 120
    most = stub_levels(counts)[1]
    assert most >= 120
    n = np.full(120, 1000, np.uint32)
    pairs = jaccard._pairs(np.full(120, 7, np.uint64), np.arange(120, dtype=np.int64), n, n, 80, most)
    assert len(pairs) == 120 * 119 // 2 and (pairs[:, 3] > pairs[:, 2]).all()


def test_counts_are_kept_finely():
    import numpy as np

    counts = np.full(jaccard.CELLS, 400)
    counts[5] += 70  # over chance, in a step of a fifth it was not to be seen
    levels = stub_levels(counts)[0]
    assert levels[5] == 1 and levels[4] == 0


def stub_levels(counts):
    """_levels of given counts, without Spark: what its task makes of them."""
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    class Signed:
        where = select = repartition = lambda self, *a: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def collect(self):
            parts = np.asarray(counts, np.uint32).reshape(1 << jaccard.RANGE_BITS, -1)
            blobs = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts]
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["cells", "counts"])
            return [SimpleNamespace(cells=r["cells"], q=r["q"]) for b in self.run([batch]) for r in b.to_pylist()]

    return jaccard._levels(Signed())
