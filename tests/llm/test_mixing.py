from collections import Counter

import numpy as np
import pytest

from deepwell.llm import mixing as M
from deepwell.llm.tokens import unpack_ids, vocabulary


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(M.feistel(np.arange(n), n, 12345)) == list(range(n))


def test_slots_follow_the_draws_and_epochs_see_each_block_once(crowded):
    rows = M.mix(crowded, {"s0": 3.0, "s1": 1.0}, block=64, shard=16).collect()
    assert {r.source for r in rows} == {"s0", "s1"}
    by = Counter((r.shard, r.slot) for r in rows)
    assert max(by.values()) == 1 and len(rows) == max(r.shard for r in rows) * 16 + sum(r.shard == max(x.shard for x in rows) for r in rows)
    for shard in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    per = Counter((r.source, r.epoch, r.block) for r in rows)
    assert max(per.values()) == 1
    full = {(r.source, r.epoch): {x.block for x in rows if (x.source, x.epoch) == (r.source, r.epoch)} for r in rows}
    for (source, epoch), blocks in full.items():
        if (source, epoch + 1) in full:
            assert blocks == set(range(max(blocks) + 1))


def test_counts_are_the_multinomial_draws(docs):
    weights = {"s0": 3.0, "s1": 1.0, "s2": 2.0}
    rows = M.mix(docs, weights, block=64, shard=16).collect()
    sources = ["s0", "s1", "s2"]
    for shard in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == shard]
        want = M.shard_counts(M.SEED, shard, len(own), [0.5, 1 / 6, 1 / 3])
        assert [sum(r.source == s for r in own) for s in sources] == want.tolist()


def test_blocks_hold_the_documents_tokens(docs, corpus):
    v = vocabulary(M.VOCABULARY)
    texts = {i: t for i, t, *_ in corpus}
    seen = {}
    for r in M.mix(docs, block=64).collect():
        assert r.n_tokens == sum(r.lengths) <= 64
        ids, at = unpack_ids(r.tokens, v.n), 0
        for doc, n in zip(r.doc_ids, r.lengths):
            part = b"".join(v.pieces[i] for i in ids[at : at + n])
            assert part in texts[doc].encode()
            seen.setdefault(r.source, {})[r.block] = r.n_tokens
            at += n


def test_a_rare_source_in_many_tasks_has_its_share_of_tokens(spark):
    v = vocabulary(M.VOCABULARY)
    word = lambda i: f"number {i} of a source "
    rows = [(i, word(i) * (1 if i % 8 == 0 else 20), None, "rare" if i % 8 == 0 else "usual") for i in range(800)] + [(800 + i, word(i), None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tokens = {s: sum(len(v._encode(t)) for _, t, _, x in rows if x == s) for s in ("rare", "usual", None)}
    slots = {}
    for tasks in (1, 40):
        got = M.mix(df.repartition(tasks), {"rare": 1.0, "usual": 1.0}, block=64, shard=16).collect()
        slots[tasks] = Counter(r.source for r in got)
        share = sum(r.n_tokens for r in got if r.source == "rare") / sum(r.n_tokens for r in got)
        assert len(got) == sum(-(-n // 64) for n in tokens.values()) and abs(share - slots[tasks]["rare"] / len(got)) < 0.02
        assert 0.4 < share < 0.6
        for source in ("rare", "usual"):
            blocks = {r.block: r for r in got if r.source == source}
            assert all(r.n_tokens == 64 for b, r in blocks.items() if b < tokens[source] // 64)
            if set(blocks) == set(range(-(-tokens[source] // 64))):  # a whole epoch was drawn
                seen = {}
                for r in blocks.values():
                    assert sum(r.lengths) == r.n_tokens == len(unpack_ids(r.tokens, v.n))
                    for doc, n in zip(r.doc_ids, r.lengths):
                        seen[doc] = seen.get(doc, 0) + n
                assert seen == {i: len(v._encode(t)) for i, t, _, x in rows if x == source}
    assert slots[1] == slots[40] and slots[1]["rare"] >= -(-tokens["rare"] // 64)


def test_every_character_comes_back(spark):
    """Blocks of 5 tokens, on letters that take several: each document's stretches are its text."""
    rows = [(i, "".join(chr(0x10000 + 977 * (i + 1) * j % 50000) if j % 3 else "ab 你"[j % 4] for j in range(3 + i % 40)), "x", f"s{i % 2}", 7.5 * i, [i, None], {"a": i}) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, meta double, place array<long>, n map<string, int>")
    got = {}
    for tasks in (1, 7):
        # weights by tokens: each source has about an epoch; slots in order of block give the text of those that are whole
        out = M._drawn(df.repartition(tasks), {"s0": 1.0, "s1": 1.0}, 5, 16, 1, M.VOCABULARY, None)
        slots = out.select("source", "metas", "lengths", "tails", "tokens", "epoch", "block", "bucket", "number").dropDuplicates(["source", "block"]).orderBy("source", "bucket", "number")
        texts = slots.coalesce(1).select("source", "metas", "lengths", "tails", "tokens").mapInArrow(M._texts(M.VOCABULARY, None, ["doc_id", "text", "meta", "place", "n"]), "doc_id long, text string, meta double, place array<long>, n map<string, int>").collect()
        got[tasks] = sorted((r.doc_id, r.text, r.meta, r.place) for r in texts)
        seen = {}
        for r in texts:
            seen.setdefault(r.doc_id, []).append(r)
            assert r.meta == 7.5 * r.doc_id and r.place == [r.doc_id, None] and r.n == {"a": r.doc_id}
        whole = 0
        for i, t, *_ in rows:
            parts = [r.text for r in seen.get(i, [])]
            assert all("\ufffd" not in p for p in parts) and sum(map(len, parts)) <= len(t)
            if sum(map(len, parts)) == len(t):
                assert Counter("".join(parts)) == Counter(t) and all(p in t for p in parts)
                whole += 1
        assert whole > 60
    assert got[1] == got[7]


def test_equal_output_under_two_partitionings(spark, docs):
    one, two = (sorted(map(repr, M.mix(docs.repartition(n), block=64, shard=16).collect())) for n in (1, 9))
    assert one == two


def test_repeated_rows_and_clashing_columns_with_null_ids(spark):
    rows = [(None, "a b c d e f " * 30, None, None)] * 3 + [(4, "x y z " * 50, "l", "s")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    crowded = df.withColumns({c: M.F.lit("x") for c in ("bucket", "hash", "rest", "meta", "tokens", "number", "shard", "block", "epoch", "before", "range", "k", "n", "metas")})
    got = M.mix(crowded, {"s": 1.0}, block=32).collect()
    assert got and {i for r in got for i in r.doc_ids} == {4}
    out = M.mixed_documents(crowded, block=32)
    assert out.columns == crowded.columns and {r.hash for r in out.collect()} == {"x"}
    less = df.select("doc_id", "text")
    assert M.mixed_documents(less, block=32).columns == ["doc_id", "text"] and len(M.mix(less, block=32).collect()) > 5


def test_defined_cases(spark, docs, none):
    assert M.mix(none).collect() == []
    with pytest.raises(ValueError):
        M.mix(docs, {"elsewhere": 1.0})
    rows = spark.createDataFrame([(1, "a b c", None, None), (None, "d e", None, "s"), (2, None, None, "s"), (3, "", None, "s")], "doc_id long, text string, lang string, source string")
    got = M.mix(rows).collect()
    assert len(got) == 2 and {r.source for r in got} <= {None, "s"}
