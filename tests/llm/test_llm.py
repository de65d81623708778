"""The operators of the optional subpackage: SQL twins, brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle
from conftest import SF

from figcorpus.llm import ann, chat, html_blocks, html_extract, html_pages, langid, mixing, packing, quality, simhash, suffix_dedup, toxicity
from figcorpus.llm.common import ORACLES, QUERIES, components, fold_of, local_components, table

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, MID, "documents").cache()


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, a clashing extra column."""
    rows = [
        (1, "", "en", "a", "x"), (2, None, "en", "b", None), (3, " \n\t ", None, None, "x"), (3, " \n\t ", None, None, "x"),
        (None, "some words here", "fr", "a", "x"), (4, "word " * 30000, "de", "c", "x"), (5, "The cat sat. " * 9, "en", "a", "x"),
        (6, "The cat sat. " * 9, "en", "a", "x"), (6, "The cat sat. " * 9, "en", "a", "x"), (7, "12345 !!! \U0001f600 é", "es", "z", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string")


def no_docs(spark):
    return odd_docs(spark).where("false")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    n, problems = oracle.compare(spark, oracle.connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert n and not problems, problems


# 1


def test_fold_reads_disguises_and_leaves_numbers():
    assert toxicity.fold("1d10t m0r0n сum id​i​ot ｌｏｓｅｒ 1055 3") == ["idiot", "moron", "cum", "idiot", "loser"]


def test_exceptions_and_heaviest_entry():
    machine = toxicity.build({" trash ": 3.0, " tras": 2.0}, [" trash can "])
    assert toxicity.evidence("a trash can".split(), machine) == (0.0, 0.0, 0.0)
    assert toxicity.evidence("you trash".split(), machine)[0] == pytest.approx(np.log(4))
    assert toxicity.evidence([], machine) == (0.0, 0.0, 0.0)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97
    assert held[held.toxic == 0].predicted.mean() < 0.01


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd_docs(spark), labels)
    assert toxicity.score(odd_docs(spark), model).count() == 10
    none = toxicity.fit(no_docs(spark), labels.where("false"))
    assert none.lexicon == {} and toxicity.score(no_docs(spark), none).count() == 0


# 2


def test_labelled_pages_are_read_as_written_and_learned():
    model = html_extract.fit()
    wrong = total = 0
    for page, labels in html_pages.labelled_pages(100, 99):
        found = html_blocks.blocks(page)
        assert [b.text for b in found] == [t for t, _ in labels]
        wrong += sum(a != b for a, (_, b) in zip(html_extract.label(found, model), labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_pages_give_their_article(spark):
    import html

    pages = table(spark, MID, "pages").toPandas()
    got = QUERIES["op2_html_extraction"](spark, MID).toPandas().set_index("page_id")
    for p in pages.itertuples():
        body = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert got.loc[p.page_id].text == "\n".join(x for x in parts if x)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    from itertools import product

    for _ in range(50):
        scores, first, steps = rng.normal(size=6), rng.normal(), rng.normal(size=(2, 2))

        def value(path):
            return sum(s * y for s, y in zip(scores, path)) + first * path[0] + sum(steps[a, b] for a, b in zip(path, path[1:]))

        best = max(product((0, 1), repeat=6), key=value)
        assert html_extract.viterbi(scores.tolist(), first, steps) == list(best)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>a&nbsp;b &lt;x&gt;"), (2, "u", "<script>x"), (3, "u", "<!--" * 9000), (4, "u", "<a" * 9000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [b.text for b in html_blocks.blocks("<p>a&nbsp;b &lt;x&gt;<p>c<b> d</b>")] == ["a b <x>", "c d"]


# 3


def test_chat_round_trip(spark):
    texts = ["a<|b", r"x<\|y<\\|", None, "\n\n", "<<|im_end|>\n", "", "<", "|im_start|>"]
    roles = ["user", "assistant", None, "us\ner\\n<|x", "system"]
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 70, 200, None]), rng.choice(roles), rng.choice(texts)) for _ in range(60)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert len(got) == len({r[0] for r in rows})
    for g in got:
        want = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == g.conv_id])
        assert [(b.role, b.text) for b in g.back] == [(r, x) for _, r, x in want]
        assert "".join(s.text for s in g.segments) == g.formatted
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0


def test_chat_order(spark):
    def valid(*roles):
        turns = spark.createDataFrame([(1, i * 40, r, "t") for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
        return chat.format_conversations(turns).first().valid

    assert valid("system", "user", "assistant", "user")
    assert not valid("system") and not valid("assistant") and not valid("user", "user") and not valid("user", "tool", "user")


# 4


def removed_by_force(rows, match=50):
    first = {}
    for d, t in rows:
        if d is not None:
            for p in range(len(t) - match + 1):
                first[t[p : p + match]] = min(d, first.get(t[p : p + match], d))
    out = []
    for d, t in rows:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - match + 1):
            if d is not None and first.get(t[p : p + match], d) < d:
                cover[p] += 1
                cover[p + match] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        out.append((-1 if d is None else d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def report(df, **settings):
    rows = suffix_dedup.dedup_report(df, suffix_dedup.Settings(**settings)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(0, 400))) for _ in range(15)]
    rows = []
    for _ in range(120):
        t = ""
        for _ in range(r.randint(0, 5)):
            b = r.choice(base)
            x = r.randint(0, len(b))
            t += b[x : r.randint(x, len(b))] + "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))
        t = r.choice([t, t, t, "ab" * r.randint(0, 200), "a" * r.randint(0, 300), rows[-1][1] if rows else ""])
        rows.append((r.choice([None, *range(90)]), t))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert report(df, chunk_rows=7) == removed_by_force([(d, t.encode()) for d, t in rows])


def test_repeats_in_documents(spark, docs):
    rows = [(r.doc_id, r.text.encode()) for r in docs.select("doc_id", "text").collect()]
    assert report(docs) == removed_by_force(rows)


def test_repeats_odd_rows(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd_docs(spark).collect()]
    assert report(odd_docs(spark)) == removed_by_force(rows)
    assert report(no_docs(spark)) == []
    left = suffix_dedup.stage_suffix_dedup(spark, odd_docs(spark), "")
    assert left.columns == odd_docs(spark).columns and left.where("doc_id = 6").count() == 0 and left.where("doc_id = 2").count() == 1


# 5


def test_pieces_hold_every_id_once(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x <|endoftext|>  \n y")], "doc_id bigint, text string"))
    pieces = packing.pack_documents(rows).toPandas()
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows.collect()}
    assert set(pieces.doc_id) == set(want)
    for doc, g in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in g.itertuples():
            ids = want[doc][p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want[doc]), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += p.length
        assert at == len(want[doc])
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    sizes = ordered.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes)


def test_close_documents_share_windows_in_many_shards(spark):
    import json

    import public_tokenizers

    # 40 topics of 30 documents in few shards
    rng = np.random.default_rng(6)
    # words of one token each
    words = [t[1:] for t, i in sorted(json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"].items(), key=lambda x: x[1]) if re.fullmatch("Ġ[a-z]{5,}", t)]
    topics, common = [words[100 + 8 * t : 108 + 8 * t] for t in range(40)], words[:30]
    rows = [(t * 100 + i, " ".join(rng.permutation([*topics[t] * 2, *rng.choice(common, 12)]))) for t in range(40) for i in range(30)]
    made = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id bigint, text string").repartition(7)
    made = made.union(spark.createDataFrame([(10**6, "same text again")] * 300, "doc_id bigint, text string"))
    got = packing.pack_documents(made, packing.Settings(window=256, shard_tokens=8000)).toPandas()
    assert (got.sequence_id // 2**32).nunique() >= 4
    full = got[got.doc_id < 10**6].assign(topic=lambda x: x.doc_id // 100)
    share = full.groupby(["sequence_id", "topic"]).length.sum().groupby("sequence_id").max() / full.groupby("sequence_id").length.sum()
    assert share.mean() > 0.75
    whole = got[got.doc_id < 10**6].groupby("doc_id").agg(n=("length", "sum"), m=("doc_tokens", "max"))
    assert len(whole) == 1200 and (whole.n == whole.m).all()


def test_cuts_in_levels_lose_nothing_and_keep_close_documents_together(spark):
    assert packing.levels(1, 256) == (1, 1) and packing.levels(256, 256) == (1, 256) and packing.levels(257, 256) == (2, 17)
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}o" for a in "bdfgklm" for b in "aeiou" for c in "nprst"]
    rows = [(t * 100 + i, " ".join(rng.permutation(words[8 * t : 8 * t + 8] * 3))) for t in range(20) for i in range(30)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    made = made.union(spark.createDataFrame([(10**6, "same text again"), (None, None)] * 100, "doc_id bigint, text string"))
    flat = packing.pack_documents(made, packing.Settings(window=256, shard_tokens=1500)).toPandas()
    deep = packing.pack_documents(made, packing.Settings(window=256, shard_tokens=1500, fan=3)).toPandas()
    assert packing.levels(flat.length.sum() // 1500, 3)[0] >= 2
    for got in (flat, deep):
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
        assert all(n <= 256 and n & (n - 1) == 0 for n in ordered.groupby("sequence_id").length.sum())
        whole = got[got.doc_id < 10**6].groupby("doc_id").agg(n=("length", "sum"), m=("doc_tokens", "max"))
        assert len(whole) == 600 and (whole.n == whole.m).all()
        part = got[got.doc_id < 10**6].assign(topic=lambda x: x.doc_id // 100)
        share = part.groupby(["sequence_id", "topic"]).length.sum().groupby("sequence_id").max() / part.groupby("sequence_id").length.sum()
        assert share.mean() > 0.75
    assert flat.length.sum() == deep.length.sum()
    of = deep.assign(shard=deep.sequence_id // 2**32).groupby("shard").length.sum()
    assert len(of) >= 9 and of.max() < 6 * 1500


def test_seed_asks_again_until_the_window_is_full():
    close = {0: [3, 5, 7, 9, 11, 13]}
    pieces = packing.pack([10] * 14, lambda seed, used: [d for d in close.get(seed, []) if not used[d]][:2], 70)
    assert [p.doc for p in pieces if p.sequence == 0] == [0, 3, 5, 7, 9, 11, 13]


def test_packing_odd_rows(spark):
    assert packing.pack_documents(no_docs(spark)).count() == 0
    got = packing.pack_documents(odd_docs(spark)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum("doc_tokens")).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6, 7}


def test_neighbours_are_bm25(spark):
    rng = np.random.default_rng(4)
    docs_ = [rng.integers(0, 30, rng.integers(1, 60)).astype("<u2") for _ in range(40)]
    s = packing.Settings(terms=1000, keep=5)
    idf, mean = rng.random(30).astype(np.float32) + 0.1, float(np.mean([len(d) for d in docs_]))
    index = packing.Index(docs_, idf, mean, s)

    def score(q, d):
        out = 0.0
        for t in set(docs_[q].tolist()):
            tf = int((docs_[d] == t).sum())
            out += idf[t] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(docs_[d]) / mean)) if tf else 0
        return out

    used = rng.random(40) < 0.3
    for q in range(40):
        got = index.neighbours(q, used)
        best = sorted((score(q, d) for d in range(40) if not used[d]), reverse=True)[:5]
        assert not used[got].any() and np.allclose([score(q, d) for d in got], best[: len(got)], rtol=1e-4)


# 6


def test_language_on_held_out_rows(spark, docs):
    got = QUERIES["op6_language_id"](spark, MID).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_logits_in_pieces():
    import pyarrow as pa

    model = langid.train([("the cat and dog", "en"), ("der hund und die katze", "de")] * 30)
    some = ["Élan vital", None, "", "a b c", "the of " * 60000, "x" * 5]
    got = langid.logits(pa.array(some), model)
    for t, g in zip(some, got):
        ids = langid._features(t or "", model.bits)
        want = model.table[ids].mean(0, dtype=float) + model.bias if len(ids) else model.bias
        assert np.allclose(want, g, atol=1e-4)


def test_rare_languages_keep_their_learning_rows(spark):
    # 20 frequent languages and rare ones share a small bound; each has words of its own
    frequent, rare = [f"f{i:02d}" for i in range(20)], [f"r{i}" for i in range(3)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = {k: [letters[i % 26] + letters[(i * 7 + 3) % 26] + letters[(i * 11 + 5) % 26]] for i, k in enumerate(frequent + rare)}
    rows = [(k, f"{names[k][0]} " * 20) for k in frequent for _ in range(300)] + [(k, f"{names[k][0]} " * 20) for k in rare for _ in range(40)]
    made = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    s = langid.Settings(per_language=60, max_rows=240, least=30)
    kept = {r.lang: r["count"] for r in langid.sample(made, s).groupBy("lang").count().collect()}
    assert len(kept) == 23 and all(10 <= kept[k] <= 60 for k in frequent) and all(kept[k] >= 15 for k in rare)
    model = langid.fit(made, s)
    assert model.head is not None and model.languages == tuple(frequent + rare)
    got = langid.identify(made, model, keep=("lang",)).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_learning_reads_whole_texts():
    s = langid.Settings()
    text = "shared opening " * 200 + "eigene worte " * 2000
    all_, got = langid._features(text, s.bits), langid.drawn(text, s)
    behind = set(langid._features("eigene worte ", s.bits)) - set(langid._features("shared opening ", s.bits))
    assert len(got) == s.max_subwords and np.isin(got, list(behind)).mean() == pytest.approx(np.isin(all_, list(behind)).mean(), abs=0.03)
    long = "wort " * (langid.CHUNK // 2)
    assert sorted(langid.drawn(long, langid.Settings(max_subwords=10**7))) == sorted(langid._features(long, s.bits))
    assert (langid.drawn(text, s) == got).all() and len(langid.drawn("", s)) == 0


def test_language_odd_rows(spark):
    model = langid.fit(odd_docs(spark))
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd_docs(spark), model).collect()}
    assert {(1, True), (2, True), (3, True), (7, False)} <= got
    empty = langid.fit(no_docs(spark))
    assert {r.lang_pred for r in langid.identify(odd_docs(spark), empty).collect()} == {"und"}
    kept = langid.stage_language(spark, odd_docs(spark), "")
    assert kept.columns == odd_docs(spark).columns and kept.where("doc_id = 2").count() == 0


# 7


def fingerprint_by_force(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_near_duplicates_against_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).toPandas().merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    assert all(int(r.fingerprint, 16) == fingerprint_by_force(r.text.encode()) for r in got.sample(150, random_state=1).itertuples())
    fps = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    root = components_by_force(fps)
    assert (got.doc_id.groupby(root).transform("min") == got.component_id).all()


@pytest.mark.parametrize("crowd", [4, 2048])
def test_links_among_crowds(spark, crowd):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 9)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    found = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"), crowd=crowd).collect()
    named = {r.node: r.root for r in found}
    got = pd.Series([named.get(int(x), int(x)) for x in fps.view(np.int64)])
    want = pd.Series(components_by_force(fps))
    assert len(set(zip(got, want))) == got.nunique() == want.nunique()


def test_near_duplicates_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    kept = simhash.stage_near_dedup(spark, odd_docs(spark), "")
    assert kept.columns == odd_docs(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    a, b = np.array([e for e in edges if e[0] != e[1]]).T
    nodes, roots = local_components(a, b)
    assert {int(n): int(r) for n, r in zip(nodes, roots)} == {**{n: n for n in set(got.values())}, **got}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 8


def test_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    got = mixing.mix_sources(df, F.col("sources"), weights=lambda s: [1, 3], share=0.88).toPandas()
    taken = {"a": 0, "b": 0}
    for r in got.itertuples():
        assert r.taken == r.size * len(r.copies) <= 2 * r.size
        for c in r.copies:
            taken[c["source"]] += r.size
    total = got["size"].sum()
    assert abs(taken["a"] - 0.22 * total) < 20 and abs(taken["b"] - 0.66 * total) < 20
    # no word is repeated while fresh ones are left
    assert got.taken.max() <= got["size"].max() and (got.repeats <= 1).all()


def test_flow_repeats_only_where_needed():
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 12, "b": 18}, 2)
    per = {p: sum(n for _, n in parts) for p, parts in given.items()}
    assert sum(per.values()) == 30 and sum(max(0, per[p] - n) for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 5}.items()) == 5


def test_targets():
    assert mixing.fill_targets([10, 10, 100], [3, 1, 2], 180, 2) == [20, 20, 140]
    assert mixing.fill_targets([], [], 0, 2) == []


def test_mixing_odd_rows(spark):
    got = mixing.mix_sources(odd_docs(spark))
    assert got.count() == 10 and got.where("taken > 2 * size").count() == 0
    assert mixing.mix_sources(no_docs(spark)).count() == 0
    assert mixing.stage_mixing(spark, odd_docs(spark), "").columns == odd_docs(spark).columns


# 9


def base_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdict(spark, docs):
    got = QUERIES["op9_quality_rules"](spark, MID).toPandas().merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    for r in got.itertuples():
        base = base_by_force(r.text)
        assert base == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r.base_failed and r.kept)
    judged = got[~got.base_failed].merge(table(spark, MID, "labels").toPandas(), on="doc_id")
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.3


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]), np.array([0.5, 0.5])
    assert quality.js_distance(p, q)[1] == 0 and quality.js_distance(p, np.array([0.0, 1.0]))[0] == pytest.approx(1)


def test_sparse_distance_is_js_distance():
    rng = np.random.default_rng(5)
    p = rng.random((20, 30)) * (rng.random((20, 30)) < 0.3)
    p, q = p / np.maximum(1e-9, p.sum(1, keepdims=True)), rng.random(30) * (rng.random(30) < 0.5)
    at, places = np.nonzero(p)
    assert np.allclose(quality.sparse_js_distance(at, p[at, places], 20, (q / q.sum())[places]), quality.js_distance(p, q / q.sum()))


def test_common_words_are_counted_over_all_documents(spark):
    # a language of many small batches, one whose words would not fit a common limit, and one of few words
    rows = [("a", "the " * (i % 3) + f"x{i}") for i in range(3000)] + [("b", " ".join(f"w{j}" for j in range(240)))] * 20
    rows += [("a", f"burst {'burst ' * 40 if i == 7 else ''}") for i in range(8)] + [("c", "few words"), (None, "no language"), ("a", None)]
    rows += [(k, " ".join(f"{k}{j}" for j in range(200))) for k in "def"]
    by_lang = {}
    for lang, text in rows:
        if lang and text:
            by_lang.setdefault(lang, []).extend(text.split())
    want = {w for words in by_lang.values() for w in words if words.count(w) >= 0.004 * len(words)}
    made = spark.createDataFrame(rows, "lang string, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for per_batch in (50, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
            for held in (100, 500_000):
                assert quality.common_words(made, quality.Settings(held_words=held, ref_docs=1, ref_words=1)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_long_text_without_common_words_fails(spark, docs):
    strange = " ".join(f"{'bcdfghjk'[i % 8]}{'aeiou'[i % 5]}{'lmnprst'[i % 7]}{'aeiou'[i % 3]}{chr(97 + i % 23)}" for i in range(2000))
    got = quality.quality(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, strange, None)], "doc_id bigint, text string, lang string")))
    (r,) = got.where("doc_id = -1").collect()
    assert not r.base_failed and not r.kept and r.word_distance > 0.3


def test_quality_odd_rows(spark):
    got = {r.doc_id: r for r in quality.quality(odd_docs(spark)).collect()}
    assert got[2].n_words == 0 and got[4].n_repeat_words == 30000 and not got[4].kept
    assert quality.quality(no_docs(spark)).count() == 0


# 10


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_nearest_neighbours"](spark, sf).toPandas()
    rows = table(spark, sf, "embeddings").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = wanted = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        assert np.allclose(own.score, far[np.searchsorted(ids, own.vec_id)], rtol=1e-12)
        hits, wanted = hits + len(set(best) & set(own.vec_id)), wanted + 10
    assert hits >= 0.9 * wanted


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [1.0]), (600, [None, 1.0])]
    rows += [(i, [1.0, 0.0]) for i in range(1, 30)] + [(None, [1.0, 2.0]), (30, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    near = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert near == {0: list(range(1, 11)), 100: list(range(10))} and len(got) == 20
    assert ann.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 30)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.vec_id, r.score) for r in few] == [(1, 0.0), (30, 2.0)]


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs_ = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, SF)
        assert out.schema.names == docs_.schema.names, name
        out = out.cache()
        assert out.count()
        docs_ = out
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.agg(F.sum("length")).first()[0] > 0


def test_pipeline_empty(spark):
    import corpus_pipeline

    docs_ = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, SF)
        assert docs_.count() == 0
