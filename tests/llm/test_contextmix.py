"""The context mix against a scalar restatement, its word counts against plain ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from inspectlake.llm import contextmix as mix
from inspectlake.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choices(["ka", "Lo", "mi", "rün", "st"], k=rng.randint(1, 4))) for _ in range(n)).encode()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(40)]
    plain, pairs = Counter(), {}
    for t in texts:
        for a, b, c in zip(b"  " + t, b" " + t, [*t, mix.END]):
            plain[c] += 1
            pairs.setdefault(a << 8 | b, Counter())[c] += 1
    found = Counter()
    for keys, times in mix._triples(tuple(texts)):
        found.update(dict(zip(keys.tolist(), times.tolist())))
    assert found == Counter({p << 9 | c: n for p, own in pairs.items() for c, n in own.items()})
    code = mix.Code(plain, {p: c for p, c in pairs.items() if p % 3})
    counts = np.zeros((len(mix.CONTEXTS), 2 << mix.SLOT_BITS), dtype=np.uint32)
    parts = [part for t in texts for part in mix.windows(t)]
    mix.add_counts(counts, mix.Bits(parts, code))
    return code, counts, [mix.log_odds(c.reshape(-1, 2)) for c in counts], mix.fit_weights(parts[:30], code, counts)


def scalar(rows, weights):
    """Bits of one window, one bit after the other, in plain floats."""
    learned, table, spent = [0.0] * len(mix.CONTEXTS), [0.0] * (mix.ODDS_STEPS + 1), 0.0
    for row in rows.tolist():
        x = [v / mix.SCALE / 2 for v in row[: len(mix.CONTEXTS)]]
        y = 2 * row[mix.BIT] - 1
        first = math.tanh(sum((float(weights[i, row[mix.GATE]]) + learned[i]) * v for i, v in enumerate(x)))
        learned = [w + v * (y - first) * float(mix.RATE) for w, v in zip(learned, x)]
        place = int(first * mix.ODDS_STEPS / 2 + mix.ODDS_STEPS / 2)
        final = first + table[place]
        table[place] += (y - final) * float(mix.ODDS_RATE)
        spent -= math.log2(min(1 - mix.LEAST, max(mix.LEAST, (1 + y * final) / 2)))
    return spent


def test_lanes_equal_one_window_at_a_time(model):
    code, _, tables, weights = model
    rng = random.Random(3)
    texts = [b"", b"k", prose(rng, 900), "ß€".encode() * 300, bytes(range(256)) * 5, b"\n" * 700, *(prose(rng, n) for n in range(1, 60, 7))]
    parts = [part for t in texts for part in mix.windows(t)]
    together = mix.mixed_bits(parts, code, tables, weights)
    for part, found in zip(parts, together):
        bits = mix.Bits([part], code)
        rows = mix.rows_of(bits, lambda c, bits=bits: tables[c][bits.slots(c)])
        assert found == pytest.approx(scalar(rows, weights), rel=2e-3)
    assert mix.mixed_bits(parts[::-1], code, tables, weights)[::-1] == pytest.approx(together, rel=1e-5)


def test_tables_tell_of_a_bit_what_the_others_counted(model):
    code, counts, _, _ = model
    few = np.minimum(counts[:, : 1 << 12], 300)
    told = mix.told_without(few)
    for c in range(len(few)):
        for i in range(0, few.shape[1], 2):
            for bit in range(2):
                zeros, ones = (min(255, max(0, int(few[c, i + b]) - (b == bit))) for b in range(2))
                odds = int(mix.log_odds(np.array([[zeros, ones]]))[0])
                expected = round(odds / mix.LEVEL) + mix.LEVELS if odds else mix.KINDS - 1
                assert told[c, i + bit] == expected
    parts = list(mix.windows(b"ka mi ka Lo st"))
    bits = mix.Bits(parts, code)
    tally = mix.tally_told(bits, mix.told_without(counts))
    assert len(tally) == mix.TOLD and tally.sum() == len(bits.bit)
    assert (mix.cells_of(tally) == mix.tally_odds(parts, code, counts)).all()


def test_codes_are_complete_prefix_codes():
    rng = random.Random(4)
    pairs = {p: {rng.randint(0, 256): rng.randint(1, 50) for _ in range(rng.randint(1, 9))} for p in range(20)}
    for plain in ({}, {i: 2**i for i in range(40)}, {i: i for i in range(257)}):
        code = mix.Code(plain, pairs)
        for tree in range(len(pairs) + 1):
            own = range(tree * mix.SYMBOLS, (tree + 1) * mix.SYMBOLS)
            paths = [[(code.nodes[i], code.bits[i]) for i in range(code.first[s], code.first[s] + code.lengths[s])] for s in own]
            # Each inner node is left by either bit, so paths of all symbols fill the code or end in another path's escape.
            assert len({tuple(b for _, b in p) for p in paths}) == mix.SYMBOLS
            words = sorted("".join(str(b) for _, b in p) for p in paths)
            assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
        assert code.lengths[: mix.SYMBOLS].max() <= 24


def test_windows_spell_the_whole_text():
    for n in (0, 1, mix.WINDOW - 1, mix.WINDOW, mix.WINDOW + 1, 3 * mix.WINDOW):
        text = bytes(i % 251 for i in range(n))
        parts = list(mix.windows(text))
        assert b"".join(p[mix.REACH :] for p, _ in parts) == text and [e for _, e in parts] == [False] * (len(parts) - 1) + [True]


def test_contexts_see_only_what_comes_before(model):
    code = model[0]
    a, b = mix.Bits(list(mix.windows(b"the same start, then this")), code), mix.Bits(list(mix.windows(b"the same start, other")), code)
    same = len(b"the same start, ") + 1
    assert all((x[:same] == y[:same]).all() for x, y in zip(a.contexts, b.contexts))
    # The word so far is the same at different places, and differs between words.
    word = mix.CONTEXTS.index(0)
    c = mix.Bits(list(mix.windows(b"ab ab ax")), code).contexts[word]
    assert c[1] == c[4] == c[7] and c[2] == c[5] and c[2] != c[8] and c[0] == c[3]


def test_words_are_cut_at_ascii_white_space(spark):
    text = " a\tB\x0bc\x0cd\re\x1cf\x85g\u2003h\ni  "
    rows = mix.count_words(spark.createDataFrame([(text,), (None,), ("",)], "text string")).filter("kind = 'w'").collect()
    expected = Counter(text.encode().lower().split()) + Counter({b"": 3})
    assert {bytes(r.word): r.n for r in rows} == expected


def test_known_text_is_cheaper(model):
    code, _, tables, weights = model
    rng = random.Random(9)
    cost = lambda t: mix.mixed_bits(list(mix.windows(t)), code, tables, weights).sum() / len(t)
    noise = bytes(rng.choices(range(97, 123), k=1500))
    assert cost(prose(rng, 200)) < 2.5 < cost(noise)


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op13_context_mix_scores(spark, SF_DIR).collect()


def test_words_equal_plain_counts(spark, scored, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    own = {r.doc_id: Counter((r.text or "").encode().lower().split()) + Counter([b""]) for r in docs}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    learned = sum((c for d, c in own.items() if not held[d]), Counter())
    space = math.log10(learned.total() + len(learned) + 1)
    expected = {
        d: (held[d], c.total(), sum(n for w, n in c.items() if learned[w]), learned.total(),
            sum(n * (math.log10(learned[w] + 1) - space) for w, n in c.items()))
        for d, c in own.items()
    }

    def check(rows):
        assert len(rows) == len(docs)
        for r in rows:
            *exact, base = expected[r.doc_id]
            assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact and r.base_score == pytest.approx(base)

    check(scored)
    monkeypatch.setattr(mix, "FREQUENT", 5)
    check(queries.op13_context_mix_scores(spark, SF_DIR).collect())


def test_held_out_documents_take_far_less_than_their_bytes(spark, scored):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = [r for r in scored if r.held_out]
    symbols = sum((Counter(texts[r.doc_id]) for r in held), Counter())
    entropy = -sum(n * math.log2(n / symbols.total()) for n in symbols.values())
    spent = -sum(r.score for r in held) / math.log10(2)
    assert held and spent < 0.65 * entropy


def test_awkward_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "w " * 3000 + "z" * 5000, 5), (3, "other", 5), (3, "other", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Bits int")
    out = mix.score(docs, "doc_id > 1", ["doc_id", "Bits"]).collect()
    assert len(out) == 6 and out[0].asDict().keys() == {"doc_id", *(f for f in ("n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "bits", "bits_per_byte"))}
    found = {(r.doc_id, r.n_bytes): r for r in out}
    assert found[1, 0].n_tokens == 1 and found[1, 0].bits_per_byte is None and found[1, 0].bits == found[2, 0].bits > 0
    assert found[3, 5].train_tokens == 1 + 3002 + 2 + 2 and found[None, 3].n_known == 1
    nothing = mix.score(docs, "false", ["doc_id"]).collect()
    assert len(nothing) == 6 and all(r.train_tokens == r.n_known == 0 and r.bits > 0 for r in nothing)
    assert mix.score(docs.limit(0), "true", ["doc_id"]).count() == 0


def test_first_weights_come_from_all_training_windows(spark, monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 400)).decode() for _ in range(50)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = []
    monkeypatch.setattr(mix, "weights_of", lambda cells, fit=mix.weights_of: found.append(cells) or fit(cells))
    assert mix.score(docs, "doc_id % 5 > 0", ["doc_id"]).count() == len(texts)
    learned = [(t or "").encode() for i, t in enumerate(texts) if i % 5]
    parts = [part for t in learned for part in mix.windows(t)]
    code = mix.fit_code(mix.count_words(docs.filter("doc_id % 5 > 0").select("text")))
    counts = np.zeros((len(mix.CONTEXTS), 2 << mix.SLOT_BITS), dtype=np.uint32)
    bits = mix.Bits(parts, code)
    mix.add_counts(counts, bits)
    assert [c.sum() for c in found] == [len(bits.bit)]
    assert counts.max() > 255 or (found[0] == mix.tally_odds(parts, code, counts)).all()
    weights = mix.weights_of(found[0])
    assert weights.shape == (len(mix.CONTEXTS), len(mix.CONTEXTS) + 1) and np.isfinite(weights).all()
