"""The dealt operators against plain versions on small, awkward tables."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import random
import urllib.parse
from collections import Counter, defaultdict

import numpy as np
import pytest

from inspectlake.llm import cutting, languages, mixing, neardup, neighbours, packing, quality, repeats, resharding, secrets
from inspectlake.llm.bwt import first_owners
from inspectlake.llm.components import components
from inspectlake.llm.flow import min_cost_flow
from inspectlake.llm.shingles import shingle_sets
from inspectlake.llm.staging import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, mix_sources string, kept string"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ru", "se", "ta") for b in ("n", "rd", "st", "vel", "x")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "two words", prose(rng, 30), prose(rng, 400), "x" * 3000, prose(rng, 9000)]
    base = prose(rng, 120)
    words = base.split()
    texts += [base, base, base.upper(), " ".join(words[:60] + ["zz"] + words[61:]), " ".join(words[5:] + ["yy"])]
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(30)]
    texts += [prose(rng, 20) + " " + base[40:160] + " " + prose(rng, 20) for _ in range(4)]
    texts += ["ä" * 40 + " übel\n" * 30, "\n".join(["same line here"] * 9 + ["other"])]
    out = [
        (i * 3 + 1, t, [None, "aa", "bb"][i % 3], [None, "s1", "s2", "s2"][i % 4], None, i, "clash", "clash")
        for i, t in enumerate(texts)
    ]
    return out + out[5:7]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(20):
        supply, demand = [rng.randint(1, 4) for _ in range(2)], [rng.randint(1, 4) for _ in range(2)]
        cost = {(i, j): rng.randint(0, 3) for i in range(2) for j in range(2)}
        arcs = [("s", ("l", i), n, 0) for i, n in enumerate(supply)] + [(("r", j), "t", n, 0) for j, n in enumerate(demand)]
        first = len(arcs)
        arcs += [(("l", i), ("r", j), 9, c) for (i, j), c in cost.items()]
        flows, total = min_cost_flow(arcs, "s", "t")
        best = {}
        for x in itertools.product(range(5), repeat=4):
            f = dict(zip(cost, x, strict=True))
            if all(f[i, 0] + f[i, 1] <= supply[i] for i in range(2)) and all(f[0, j] + f[1, j] <= demand[j] for j in range(2)):
                amount = sum(x)
                best[amount] = min(best.get(amount, 99), sum(f[k] * cost[k] for k in cost))
        most = max(best)
        assert (sum(flows[first:]), total) == (most, best[most])


def test_targets_stop_at_twice_the_size():
    sizes, weights = [10, 100, 1000], [3, 1, 2]
    got = mixing.targets(sizes, weights, 600.0, 2)
    assert got[0] == 20 and sum(got) == pytest.approx(600) and got[2] == pytest.approx(2 * got[1])
    assert mixing.targets([0, 0], [3, 1], 0.0, 2) == [0.0, 0.0]


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(2)
    made = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["c"], [None], ["c", None], [], None]), rng.randint(0, 40), "own") for i in range(600)]
    frame = spark.createDataFrame(made, "doc_id long, member array<string>, size long, source string")
    mixed, quotas = mixing.mix(stage(frame, "m"), "member", "size")
    out = mixed.collect()
    assert sorted(r.doc_id for r in out) == list(range(600)) and mixed.columns == [*frame.columns, "mix_sources"]
    taken = Counter()
    for r in out:
        assert len(r.mix_sources) <= 2 and all(s in (r.member or []) for s in r.mix_sources)
        for s in r.mix_sources:
            taken[s] += r.size
    aims = {r.source: (r.source_size, r.target) for r in quotas.collect()}
    assert list(aims) == ["a", "b", "c", None]
    for s, (size, target) in aims.items():
        assert target <= 2 * size and abs(taken[s] - target) <= 45, s
    again, _ = mixing.mix(stage(frame.repartition(5), "m"), "member", "size")
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_mix_handles_awkward_and_empty_tables(spark, docs):
    mixed, quotas = mixing.mix_table(docs, "size")
    assert mixed.count() == docs.count() and quotas.count() == 3
    empty, none = mixing.mix_table(docs.limit(0), "size")
    assert empty.count() == 0 and none.count() == 0


def test_number_and_divide_of_a_hot_group(spark):
    frame = spark.range(2000).selectExpr("id as doc_id", "if(id % 10 < 9, 'hot', 'cold') as g", "id % 7 as w", "xxhash64(id) as o")
    slots = cutting.number(frame, "g", "o", "doc_id", "slot").collect()
    for g in ("hot", "cold"):
        assert sorted(r.slot for r in slots if r.g == g) == list(range(sum(r.g == g for r in slots)))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows without doc_id, a third with one and the same."""
    key = "case id % 3 when 0 then null when 1 then 5 else 10 + id end"
    return stage(spark.range(3000).selectExpr(f"{key} as doc_id", "'s' as source", "array('s') as member", "id % 7 + 1 as size", "0 as old"), "hot")


def largest_range(monkeypatch):
    seen, ranges = [], cutting._ranges

    def spy(df, group, order, weight, part, *names):
        split, sums = ranges(df, group, order, weight, part, *names)
        seen.append(max(r["count"] for r in split.groupBy(group, part).count().collect()))
        return split, sums

    monkeypatch.setattr(cutting, "_ranges", spy)
    return seen


def test_equal_keys_do_not_meet_in_a_range(hot, monkeypatch):
    seen = largest_range(monkeypatch)
    placed = resharding.reshard(hot, "old", "size", 3).collect()
    mixed, _ = mixing.mix(hot, "member", "size")
    assert len(placed) == mixed.count() == 3000 and len({(r.shard, r.slot) for r in placed}) == 3000
    assert len(seen) == 3 and max(seen) < 300


def test_equal_keys_do_not_meet_in_a_group(hot, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    packed = packing.pack(hot.withColumn("cluster", hot.source), "size", "source", "cluster").collect()
    assert len(packed) == 3000 and max(Counter(r.bin >> 32 for r in packed).values()) < 300


def test_equal_keys_are_sampled_and_dealt_like_others(spark, monkeypatch):
    samples, learn = [], neighbours.learn
    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    monkeypatch.setattr(neighbours, "learn", lambda sample, *rest: samples.append(len(sample)) or learn(sample, *rest))
    frame = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 7, id) as vec_id", "array(float(sin(id)), float(cos(id)), float(sin(id * 3)), 1f) as embedding"
    )
    for hot in (7, 8, 9):
        out = neighbours.search(frame.selectExpr(f"if(vec_id = 7, {hot}, vec_id) as vec_id", "embedding"), "vec_id", "embedding", "vec_id % 500 = 1", k=5).collect()
        assert len(out) == 20
    assert all(50 < n < 200 for n in samples)


@pytest.mark.parametrize("empty", [False, True])
def test_resharding_moves_the_fewest_bytes(spark, docs, empty, tmp_path):
    frame = docs.selectExpr("*", "cast(if(doc_id % 5 < 4, 0, doc_id % 3) as int) as old", "octet_length(coalesce(text, '')) + 1 as bytes")
    frame = stage(frame.limit(0) if empty else frame, "r")
    placed = stage(resharding.reshard(frame, "old", "bytes", 4), "p")
    out = placed.collect()
    assert len(out) == frame.count() and placed.columns == [*frame.columns, "shard", "slot"]
    size = Counter()
    for r in out:
        size[r.shard] += r.bytes
    for shard in size:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    if not empty:
        rest = sum(b for b in size.values()) / 4
        largest = max(r.bytes for r in out)
        assert all(abs(size[s] - rest) <= largest for s in range(4))
        touched = resharding.rewrite(placed, "old", str(tmp_path / "shards"))
        assert {p.name for p in (tmp_path / "shards").glob("shard=*")} <= {f"shard={i}" for i in touched}


def test_rewrite_to_fewer_shards_leaves_each_row_once(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = stage(spark.range(200).selectExpr("id as doc_id", "10 as bytes", "cast(id % 4 as int) as old"), "few")
    rows.withColumn("shard", rows.old).write.partitionBy("shard").parquet(path)
    placed = stage(resharding.reshard(rows, "old", "bytes", 2), "fewer")
    assert resharding.rewrite(placed, "old", path) == [0, 1, 2, 3]
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {"shard=0", "shard=1"}
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(200))


def test_transfers_keep_what_can_stay():
    moved = resharding.transfers({0: 10, 1: 2}, [4, 4, 4])
    assert sum(n for (i, j), n in moved.items() if i != j) == 6 and moved[0, 0] == 4 and moved[1, 1] == 2
    assert resharding.even(10, 4) == [3, 3, 2, 2]


def slow_best_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [
            (b["room"] - length, i)
            for i, b in enumerate(bins)
            if b["room"] >= length and source not in b["s"] and (cluster is None or cluster not in b["c"])
        ]
        if fits:
            tight = min(fits)[0]
            at = [i for rest, i in fits if rest == tight]
        else:
            bins.append({"room": capacity, "s": set(), "c": set()})
            at = [len(bins) - 1]
        out.append(at)
        yield_ = at
        # Any bin of the tightest room will do; the caller says which one was taken.
        chosen = yield yield_
        bins[chosen]["room"] -= length
        bins[chosen]["s"].add(source)
        bins[chosen]["c"].add(cluster)


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(30):
        pieces = [(rng.randint(0, 20), rng.choice("abcd"), rng.choice([None, 1, 2, 3])) for _ in range(60)]
        got = packing.best_fit(pieces, 20)
        slow = slow_best_fit(pieces, 20)
        allowed = next(slow)
        for i, chosen in enumerate(got):
            assert chosen in allowed
            if i + 1 < len(got):
                allowed = slow.send(chosen)


@pytest.mark.parametrize("empty", [False, True])
def test_packing_is_whole_and_without_conflicts(spark, docs, empty, monkeypatch):
    frame = docs.selectExpr("*", "md5(text) as cluster").withColumn("size", docs.doc_id * 7 - 5)
    packed = packing.pack(frame.limit(0) if empty else frame, "size", "source", "cluster", capacity=64).collect()
    if empty:
        assert packed == []
        return
    size = {r.doc_id: max(0, r.size) for r in frame.collect()}
    info = {r.doc_id: (r.source, r.cluster) for r in frame.collect()}
    total, bins = Counter(), defaultdict(list)
    for r in packed:
        total[r.doc_id] += r.length
        bins[r.bin].append(r)
    times = Counter(r.doc_id for r in frame.collect())
    assert total == Counter({d: n * times[d] for d, n in size.items()})
    for held in bins.values():
        assert sum(r.length for r in held) + held[0].residual == 64 and held[0].residual >= 0
        assert sorted(r.place for r in held) == list(range(len(held)))
        for position in (0, 1):
            marks = [info[r.doc_id][position] for r in held if position == 0 or info[r.doc_id][1] is not None]
            assert len(marks) == len(set(marks))


def slow_features(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def test_quality_features_and_verdicts(spark, docs):
    extra = spark.createDataFrame(
        [(-1, "a b c d e f g h i " * 5 + "#$%", "aa", "s1"), (-2, "k " * 40, None, None), (-3, "p q r s t u v w " * 2 + prose(random.Random(5), 50), "aa", "s2")],
        "doc_id long, text string, lang string, source string",
    )
    measured = stage(quality.features(docs.select(extra.columns).union(extra)), "q")
    for r in measured.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_features(r.text)
    judged = quality.judge(measured).collect()
    assert len(judged) == docs.count() + 3
    for r in judged:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(stage(quality.features(docs.limit(0)), "q")).collect() == []


def test_thresholds_follow_the_source(spark):
    def text(i, mark):
        return " ".join(f"w{i}x{j}{mark}" for j in range(40))

    made = [(i, text(i, "##"), "aa", "code") for i in range(300)] + [(1000 + i, text(i, ""), "aa", "news") for i in range(300)]
    made.append((9999, text(9999, "##"), "aa", "news"))
    measured = stage(quality.features(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")), "q")
    kept = {r.doc_id: r.kept for r in quality.judge(measured).collect()}
    assert not kept.pop(9999) and all(kept.values())


def test_language_by_words_then_grams(spark):
    rng = random.Random(6)
    words = {"aa": ["lorem", "ipsum", "dolor", "sitam"], "bb": ["kwzyk", "wzrok", "krzyk", "zwykl"]}
    made = [(" ".join(rng.choice(words[k]) for _ in range(12)), k) for _ in range(60) for k in words] + [("lorem", None), (None, "aa")]
    model = languages.fit(spark.createDataFrame(made, "text string, lang string"))
    assert model["langs"] == ["aa", "bb"] and "lorem" in model["words"]
    asked = [
        (1, "Lorem, IPSUM!", "x"), (2, "krzyk", "x"), (3, "ipsolor", "x"), (4, "wzryk", "x"), (5, None, "x"), (6, "", "x"),
        (7, "123 --", "x"), (8, "ipsum" * 5000, "x"),
    ]
    out = {r.doc_id: r for r in languages.predict(spark.createDataFrame(asked, "doc_id long, text string, score string"), model).collect()}
    assert [out[i].lang_pred for i in range(1, 9)] == ["aa", "bb", "aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = languages.fit(spark.createDataFrame([], "text string, lang string"))
    frame = spark.createDataFrame(asked, "doc_id long, text string, x string")
    assert {r.lang_pred for r in languages.predict(frame, nothing).collect()} == {"und"}


def slow_components(rows, k, percent):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, k, percent):
    out = neardup.near_duplicates(docs, k=k, percent=percent).collect()
    want = slow_components(rows, k, percent)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert any(r.doc_id != r.component_id for r in out)


def test_near_duplicates_chained_through_a_bucket(spark):
    """Copies of a base, each with its own change: the smallest alone does not reach all."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    made = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"q{i}x{at}"
        made.append((100 - i, " ".join(words)))
    made.append((7, None))
    out = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), k=3, percent=85).collect()
    want = slow_components(made, 3, 85)
    assert {r.doc_id: r.component_id for r in out} == {d: c for d, (_, c) in want.items()}


def test_near_duplicates_of_nothing_and_without_keys(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(frame).collect() == []
    keyless = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    out = neardup.near_duplicates(keyless).collect()
    assert sorted((r.doc_id is None, r.component_id or 0, r.kept) for r in out) == [(False, 3, True), (True, 0, False), (True, 3, False)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    sketcher = neardup.Sketcher(neardup.bands_needed(0.85))
    a, b = (rng.integers(0, 2**64, 400, dtype=np.uint64) for _ in range(2))
    joint = np.concatenate([a[:300], b])
    merged = np.maximum(sketcher.registers(a[:300]), sketcher.registers(b))
    assert (merged == sketcher.registers(joint)).all()
    got = neardup.likelihood_estimate(sketcher.registers(a)[None], sketcher.registers(joint)[None], np.array([400]), np.array([700]))
    assert abs(got[0] - 300 / 800) < 0.15


def test_shingles_do_not_depend_on_place_or_slices(monkeypatch):
    from inspectlake.llm import shingles

    text = prose(random.Random(9), 500).encode()
    whole = shingle_sets([text, b"x " + text, b""], 3)
    assert set(whole[0]) <= set(whole[1]) and len(whole[2]) == 0
    monkeypatch.setattr(shingles, "SLICE", 64)
    assert all((x == y).all() for x, y in zip(whole, shingle_sets([text, b"x " + text, b""], 3), strict=True))


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(50)]
    rng.shuffle(chain)
    edges = chain + [(200, i) for i in range(100, 199)] + [(300, 300)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 201) if i != 199}}


def slow_repeats(rows):
    first, out = {}, {}
    for d, text in sorted({(r[0], r[1]) for r in rows}):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        strings = [raw[i : i + 50] for i in range(len(raw) - 49)]
        for i, s in enumerate(strings):
            if first.get(s, d) < d:
                covered[i : i + 50] = b"\1" * 50
        for s in strings:
            first.setdefault(s, d)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        rest = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out[d] = (len(raw), sum(covered), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("bound", [4096, 1])
def test_repeated_strings(spark, docs, rows, bound, monkeypatch):
    """With transforms in blocks, and string by string as for very common anchors."""
    monkeypatch.setattr(repeats, "HOT_DOCS", bound)
    out = repeats.repeated_strings(docs).collect()
    want = slow_repeats(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), r.kept_sha256) == want[r.doc_id]
    assert repeats.repeated_strings(docs.limit(0)).collect() == []


def test_interval_expansion_finds_equal_strings():
    rng = random.Random(3)
    for _ in range(100):
        length, letters = rng.choice([1, 2, 3, 5, 13]), rng.choice([b"a", b"ab", b"abc\xff\x00"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 30))) for _ in range(rng.randint(1, 12))]
        owners = np.array([rng.randint(0, 9) for _ in strings])
        first = {}
        for s, o in zip(strings, owners, strict=True):
            for i in range(len(s) - length + 1):
                first[s[i : i + length]] = min(first.get(s[i : i + length], 99), o)
        for s, got in zip(strings, first_owners(strings, owners, length), strict=True):
            assert got.tolist() == [first[s[i : i + length]] for i in range(len(s) - length + 1)]


KEY = "AKIA" + "ABCD1234" * 2


def coded(text):
    return base64.b64encode(text if isinstance(text, bytes) else text.encode()).decode()


@pytest.mark.parametrize(
    "text, spans",
    [
        (None, []), ("", []), ("token = abc12", []), ("é passwd: 'hunter22'", [("assign", 2, 19, 0)]),
        (f"x {KEY} y", [("access", 2, 22, 0)]), ("a" * 23, []), ("g " + "0a" * 12, [("hex", 2, 26, 0)]),
        ("%41KIA" + "ABCD1234" * 2, [("access", 0, 22, 1)]), ("\\u0041KIA" + "ABCD1234" * 2, [("access", 0, 25, 1)]),
        (f"é {coded(f'key {KEY} end')} z", [("access", 2, 42, 1)]),
        (f"q {coded(urllib.parse.quote(coded('api_key: ' + 'x9' * 8), safe=''))}", [("assign", 2, 58, 2)]),
    ],
)
def test_secrets_of_all_layers(text, spans):
    got = secrets.find(text)
    assert [s[:3] for s in got] == [s[:3] for s in spans]
    assert [bool(s[3]) for s in got] == [bool(s[3]) for s in spans]


def test_compressed_layers_and_cycles():
    packed = coded(gzip.compress(f"token={'zq12' * 8}".encode()))
    assert [s[0] for s in secrets.find(f"see {packed}.")] == ["assign"]
    nested = KEY
    for _ in range(6):
        nested = coded(f"layer {nested} end")
    assert secrets.find(nested)[-1][3] == 6
    assert secrets.find("%25" * 500 + "25") == []
    assert secrets.find("\\x41" * 2000 + " " + "A" * 5000) == []


def kinds(text):
    return {s[0] for s in secrets.find(text)}


def wrap(text, width):
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


def test_packed_layers_have_no_budget(monkeypatch):
    rng = random.Random(11)
    filler = b"some words of no interest. " * 1_300_000  # 35 MB
    bombs = " ".join(coded(gzip.compress(filler + bytes([65 + i]), 1)) for i in range(2))
    late = coded(gzip.compress(f"token={'zq12' * 8}".encode()))
    text = f"{bombs} see {late}."
    assert [s[:3] for s in secrets.find(text)] == [("assign", len(bombs) + 5, len(text) - 1)]
    monkeypatch.setattr(secrets, "WINDOW", 2000)
    monkeypatch.setattr(secrets, "OVERLAP", 300)
    monkeypatch.setattr(secrets, "PIECE", 100)
    monkeypatch.setattr(secrets, "LONGEST", 4000)
    for before in range(1700, 2300, 37):
        assert kinds(coded(gzip.compress(f"{prose(rng, 2000)[:before]} {KEY} {prose(rng, 900)}".encode()))) == {"access"}
    assert kinds(coded(gzip.compress(f"password {' ' * 9000}={' ' * 9000}hunter22".encode()))) == {"assign"}
    inner = coded(gzip.compress(rng.randbytes(9000) + f" {KEY} ".encode() + rng.randbytes(9000)))
    assert kinds(coded(gzip.compress(f"x {inner} y".encode()))) == {"access"}
    assert kinds(coded(gzip.compress(f"x {inner} token: abcdef1 y".encode()))) == {"access", "assign"}


def test_wrapped_joined_and_damaged_layers():
    for width in (64, 76):
        for shift in range(0, 60, 7):
            assert kinds(wrap(coded("w " * (20 + shift) + KEY + " v" * 60), width)) == {"access"}
        packed = gzip.compress(random.Random(1).randbytes(300) + f" {KEY} ".encode())
        assert kinds("x\n" + wrap(coded(packed), width) + "\n") == {"access"}
    for pack in (gzip, bz2, lzma):
        two = pack.compress(b"first member of two") + pack.compress(f"key {KEY} end".encode())
        assert kinds(coded(two)) == {"access"}
    assert kinds(coded(f"some words {KEY} ".encode() + b"\xff and more")) == {"access"}
    assert kinds("%FF" + urllib.parse.quote("é") + "".join(f"%{ord(c):02X}" for c in KEY)) == {"access"}
    assert secrets.find("%FF%41KIA" + KEY[4:])[0][:3] == ("access", 3, 25)


def test_scan_and_redact_keep_all_rows(spark, docs):
    frame = docs.selectExpr("*", "'x' as secrets").withColumn("text", docs.text)
    planted = spark.createDataFrame([(999, f"a {KEY} b token: abcdef1 c")], "doc_id long, text string")
    both = frame.select("doc_id", "text").union(planted)
    out = {r.doc_id: r for r in secrets.scan(both).collect()}
    assert len(out) == len({r.doc_id for r in both.collect()}) and [s.kind for s in out[999].secrets] == ["access", "assign"]
    assert secrets.scan(frame).count() == docs.count() and secrets.scan(frame.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(both).collect()}
    assert clean[999] == "a [SECRET] b [SECRET] c" and clean[1] is None


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_neighbours_reach_the_recall(spark, spread):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((700, 24)) * (1 + spread * rng.random((700, 1)))
    vectors[5] = vectors[6]
    made = [(i, [float(np.float32(x)) for x in v], "clash") for i, v in enumerate(vectors)]
    made += [(900, None, ""), (920, [0.0] * 24, ""), (940, [float("nan")] * 24, ""), (960, [1.0, None] * 12, ""), (980, [1.0], "")]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<float>, score string")
    out = neighbours.search(frame, "vec_id", "embedding", "vec_id % 20 = 0").collect()
    single = vectors.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 700, 20):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        scores = single @ single[q]
        assert np.allclose([r.score for r in own], scores[[r.vec_id for r in own]])
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        scores[q] = -np.inf
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(700), -scores))[:20].tolist()))
    assert len(out) == 700 and hits / 700 >= 0.9


def test_neighbours_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = neighbours.search(few, "vec_id", "embedding", "vec_id % 20 = 0").collect()
    assert sorted((r.rank, r.vec_id) for r in out) == [(1, 1), (2, 2)]
    assert neighbours.search(few.limit(0), "vec_id", "embedding", "vec_id % 20 = 0").collect() == []


def test_index_retrieves_every_code_within_the_radius():
    codes = np.random.default_rng(2).integers(0, 256, (500, 4), dtype=np.uint8)
    index = neighbours.Index(codes)
    for radius in (0, 3, 7, 12, 32):
        want = np.flatnonzero(neighbours.hamming(codes[0], codes) <= radius)
        assert (index.within(codes[0], radius) == want).all()


def test_clashing_names_of_other_case_are_replaced(spark):
    docs = spark.createDataFrame([(i, i % 3, 10 + i, "s", "x", "x", "x") for i in range(20)], "doc_id long, old int, size long, source string, Shard string, SLOT string, Mix_Sources string")
    placed = resharding.reshard(docs.drop("Mix_Sources"), "old", "size", 2)
    assert {r.shard for r in placed.collect()} == {0, 1} and [c.lower() for c in placed.columns].count("shard") == 1
    mixed, _ = mixing.mix_table(docs, "size")
    assert [c.lower() for c in mixed.columns].count("mix_sources") == 1 and mixed.count() == 20
