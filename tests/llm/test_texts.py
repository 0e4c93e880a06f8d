"""The text operators against brute force, exact round trips and held-out cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from strandweave.llm import charmodel, garble, leaks, pieces, tokens
from strandweave.llm.queries import QUERIES

SLOW = "p8_leaks", "p9_restored"


def _pieces(s, limit, overlap, patterns):
    if s is None or len(s) <= limit:
        return []
    ends = [[m.end() for m in re.finditer(p, s)] for p in patterns]
    out, start = [], 0
    while len(s) - start > limit:
        fit = next((c for e in ends if (c := [x for x in e if start + overlap < x <= start + limit])), [start + limit])
        out.append((start, max(fit)))
        start = max(fit) - overlap
    return [*out, (start, len(s))]


@pytest.mark.parametrize("seed", range(2))
def test_pieces_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", "A" * 50, "A" * 51, "n" * 300, "N" * 9 + "A" * 100] + ["".join(rng.choice(["ACGT", "N" * rng.randrange(1, 25), "acgt" * rng.randrange(1, 12)]) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    texts += [texts[-1]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "item_id long, sequence string, piece_no int")
    got = rows(pieces.split_oversized(df, "item_id", "sequence", 50, 7))
    want = [(i, k + 1, s, e) for i, t in enumerate(texts) for k, (s, e) in enumerate(_pieces(t, 50, 7, pieces.SEQUENCE_BOUNDARIES))]
    assert got == sorted(want)
    assert rows(pieces.split_oversized(df.limit(0), "item_id", "sequence", 50, 7)) == []


def test_pieces_by_words(spark):
    text = "one two. three four five six. seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = pieces.split_oversized(df, "id", "t", 5, 1, [r"\."], r"\S+\s*")
    parts = [(r.piece_start, r.piece_end) for r in got.orderBy("piece_no").collect()]
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(len(re.findall(r"\S+", text[s:e])) <= 5 for s, e in parts)
    assert all(len(re.findall(r"\S+", text[b[0] : a[1]])) == 1 for a, b in zip(parts, parts[1:]))


def test_pieces_refuse_bad_overlap(spark):
    with pytest.raises(ValueError):
        pieces.split_oversized(spark.createDataFrame([(1, "a")], "i long, t string"), "i", "t", 5, 5)


def _reference_ids():
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_tokens_equal_the_other_library(spark):
    rng = random.Random(5)
    bits = list(" \t\n\r  　abreLLv's''-_.,9½٣éñ中文字🙂<|endoftext|>​�") + ["'s", "'re", " '", "''s", "-'ll", "\x1c", "\x85", "the ", "house"]
    texts = ["", None, "   ", "a" * 30_000, "中" * 5_000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = dict(tokens.encode_texts(df, "doc_id", "text").collect())
    assert [got[i] for i in range(len(texts))] == _reference_ids()([t or "" for t in texts])
    assert rows(tokens.encode_texts(df.limit(0), "doc_id", "text")) == []


def test_tokens_of_sliced_batches_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    texts = pa.array(["x", "hello world again and again", None, "", "ÄÖ ü"])
    encoder = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert encoder(texts[1:]).to_pylist() == encoder(texts).to_pylist()[1:]
    assert encoder(texts).to_pylist() == _reference_ids()([t or "" for t in texts.to_pylist()])


def _copied(docs, items):
    grams = {}
    for i, t in items:
        w = leaks.words(t or "")
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leaks.words(t or "")] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}


@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"Name{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(5, 70)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b")]
    items += [(93, items[0][1])]
    docs = []
    for d in range(400):
        w = make(rng.randrange(0, 120))
        if rng.random() < 0.5:
            source = rng.choice(items[:40])[1].split()
            n = rng.choice([12, 13, 14, 30])
            at = rng.randrange(max(1, len(source) - n + 1))
            spot = rng.randrange(len(w) + 1)
            w[spot:spot] = [x.upper() for x in source[at : at + n]]
        docs.append((d, rng.choice([" ", "-", ", ", "\n"]).join(w)))
    docs += [(900, None), (901, ""), (902, items[3][1] * 2), (903, items[3][1] * 2)]
    d = spark.createDataFrame([(*x, 0.0) for x in docs], "doc_id long, text string, cosine double")
    i = spark.createDataFrame(items, "eval_id long, text string")
    got = leaks.find_leaks(d, i, "doc_id", "text", "eval_id", "text", paraphrases=False)
    assert {(r.doc_id, r.eval_id) for r in got.collect()} == _copied(docs, items)
    assert rows(leaks.find_leaks(d.limit(0), i, "doc_id", "text", "eval_id", "text")) == []
    assert rows(leaks.find_leaks(d, i.limit(0), "doc_id", "text", "eval_id", "text")) == []


def test_leaks_in_blocks_and_paraphrases(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 50)
    base = "the keeper of Morvel counted 38 copper lamps before the northern storm closed the road to Jondax and wrote nothing down afterwards"
    other = [f"item{k} " + " ".join(f"z{k}x{j}" for j in range(25)) for k in range(5)]
    items = spark.createDataFrame([(0, base), *[(k + 1, t) for k, t in enumerate(other)]], "eval_id long, text string")
    changed = base.replace("counted", "tallied").replace("closed", "shut").replace("wrote", "put")
    docs = spark.createDataFrame([(1, changed), (2, "before that " + base), (3, "quite another text about lamps and roads " * 4)] + [(10 + k, f"filler text {k}") for k in range(50)], "doc_id long, text string")
    got = {(r.doc_id, r.eval_id): r for r in leaks.find_leaks(docs, items, "doc_id", "text", "eval_id", "text").collect()}
    assert set(got) == {(1, 0), (2, 0)}
    assert got[(2, 0)].run_words == 22 and got[(1, 0)].run_words == 0 and got[(1, 0)].lcs_share > 0.6


def test_common_subsequence_and_run():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
                run[x + 1][y + 1] = run[x][y] + 1 if a[x] == b[y] else 0
        assert leaks.lcs_length(a, b) == table[-1][-1]
        assert leaks.longest_run(a, b) == max(map(max, run))


CLEAN = [
    "Die Tür schließt über Nacht nicht, später läuft das Gerät mühelos weiter.", "Après trois mois, l’écran reste très net et la pièce est déjà usée.", "El señor compró más piñas después del otoño; la medición salió bien.",
    "The café sells jam — it’s €3 at 40 °C, and that’s fine.", "Посылка пришла быстро, всё работает без единого сбоя и очень тихо.", "掃除は簡単で、音がとても静かです。返事も早くて助かりました。", "Η μέτρηση είναι σωστή και το καπάκι κλείνει καλά.",
    "Plain text without anything special in it.", "A MÁQUINA NÃO VAZA E A TAMPA É BOA, DIZ A IRMÃ.",
]
CHAINS = [[("utf-8", "cp1252")], [("utf-8", "latin-1")], [("utf-8", "cp1251")], [("utf-8", "cp437")], [("utf-8", "mac_roman")], [("cp1252", "cp437")], [("cp1252", "mac_roman")], [("utf-8", "cp1252"), ("utf-8", "cp1252")]]


def _corpus():
    rng = random.Random(4)
    docs, truth = [], {}
    for i in range(900):
        parts = rng.sample(CLEAN, 3)
        text = " ".join(parts)
        if i % 20 == 0:
            spot = rng.randrange(3)
            wrong = garble.garble(parts[spot], CHAINS[(i // 20) % len(CHAINS)])
            if wrong != parts[spot]:
                truth[i] = text
                text = " ".join([*parts[:spot], wrong, *parts[spot + 1 :]])
        docs.append((i, text))
    return docs, truth


def test_garbled_texts_are_found_and_restored(spark):
    docs, truth = _corpus()
    extra = [(2000, None), (2001, ""), (2002, "lost: � here"), (2003, "ascii only"), (2004, docs[1][1]), (2005, "é"), (2006, docs[0][1])]
    df = spark.createDataFrame([(*x, True) for x in docs + extra], "doc_id long, text string, lost boolean")
    got = {r.doc_id: r for r in garble.find_garbled(df, "doc_id", "text").collect()}
    want = {*truth, 2002} | ({2006} if 0 in truth else set())
    assert set(got) == want
    restored = sum(got[i].restored == t for i, t in truth.items())
    assert restored >= 0.9 * len(truth)
    assert got[2002].lost


def test_garbled_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(garble.find_garbled(df, "doc_id", "text")) == []


def test_model_counts_like_one_pass(spark):
    texts = ["abcabc", "äbc", None, "", "é" * 50]
    split = charmodel.train(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t")
    batch = pa.RecordBatch.from_arrays([pa.array([t for t in texts if t is not None])], names=["text"])
    whole = {b.column(0)[0].as_py(): b for b in charmodel.counted(iter([batch.column(0).to_pylist()]))}
    for level, table in enumerate((split.tri, split.bi, split.uni, split.runs)):
        b = whole[level]
        assert table.sum() == sum(b.column(2).to_pylist()) and all(table[p] == n for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW)))
def test_queries_run(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() == df.distinct().count() if name != "p7_ids" else df.count() > 0


def test_copies_of_a_garbled_text_are_found(spark):
    docs, _ = _corpus()
    wrong = garble.garble("Всё работает быстро и очень тихо, посылка пришла без сбоя.", [("cp1251", "latin-1")])
    df = spark.createDataFrame(docs + [(3000 + i, wrong) for i in range(300)], "doc_id long, text string")
    got = {r.doc_id for r in garble.find_garbled(df, "doc_id", "text").collect()}
    assert {3000 + i for i in range(300)} <= got


def test_every_passage_pair_of_an_item_is_checked():
    one, two = list(range(26)), list(range(26, 52))
    index = leaks.ItemIndex([0], [one + two], {f"w{i}": i for i in range(52)}, np.ones(52), np.eye(52, dtype=np.float32), [(0, 0, 26), (0, 26, 52)], None, None, np.ones(52, dtype=bool))
    index.latent = leaks.project([one, two], index.weights, index.basis)
    index.lengths = np.linalg.norm(index.latent, axis=1)
    # The same words backwards are more alike, and a paraphrase of the other passage is the one to be found.
    backwards, changed = [f"w{i}" for i in reversed(one)], [f"w{i}" if i % 4 else "other" for i in two]
    found = list(leaks.Searcher(index, leaks.COSINE, paraphrases=True).search([" ".join(backwards + changed)]))
    assert [f[:2] for f in found] == [(0, 0)] and found[0][4] >= leaks.LCS_SHARE and found[0][5] >= leaks.ANSWER_SHARE


def test_a_place_is_tried_wide_and_narrow(spark):
    text = CLEAN[5]
    model = charmodel.train(spark.createDataFrame([(" ".join([t, CLEAN[k]]),) for k in range(5) for t in CLEAN] + [(text,)] * 9, "t string"), "t")
    restorer = garble.Restorer(model, 18.0, garble.Undoer())
    wrong = text.encode("euc_jp").decode("latin-1")
    frame = garble.EDGE * 2, wrong, garble.EDGE * 2
    restorer.best(*frame)
    assert restorer.best(*frame, True)[2] == text


def test_margin_lies_in_the_gap_of_the_gains():
    clean, wrong = [-np.inf] * 900 + [1.0, 3.0, 6.0, 5.5], [40.0 + i for i in range(60)]
    assert 6 < garble.set_margin([*clean, 45.0, 90.0], wrong) < 40
    assert garble.set_margin(clean, wrong[:5]) == garble.PRIOR_MARGIN
    # Nearer noise and signal move it: it isn't a constant.
    assert garble.set_margin([*clean, 20.0], wrong) > garble.set_margin([*clean, 45.0], [12.0 + i for i in range(60)])


def test_own_part_is_left_out_of_a_group_as_of_a_text_alone(spark):
    texts = [" ".join([CLEAN[k % 9], CLEAN[(k * 5 + 2) % 9]]) for k in range(12)]
    model = charmodel.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    judge = garble.Restorer(model, 5.0, garble.Undoer())
    whole = {i: (sums.tolist(), runs) for i, sums, runs in judge._losses(texts, list(range(12)), -1e9)}
    for i, t in enumerate(texts):
        for _, sums, runs in judge._losses([t], [0], -1e9):
            assert np.allclose(sums, whole[i][0]) and runs == whole[i][1]


def test_garbled_of_every_kind_in_a_large_corpus(spark):
    """Every chain, wholly or in one place, also where many texts were read wrongly in the same way."""
    rng = random.Random(9)
    japanese = ["掃除は簡単で、音がとても静かです。", "返事も早くて助かりました。", "蓋がしっかり閉まり、四度でも漏れません。", "耐久性はまだわかりません。"]
    greek = ["Η μέτρηση είναι σωστή και το καπάκι κλείνει καλά.", "Απάντησαν γρήγορα και ευγενικά.", "Το χρώμα είναι πιο σκούρο από τη φωτογραφία."]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.sample(CLEAN + japanese + greek, 3)) + f" {i}") for i in range(1500)]
    truth = {}
    for k in range(6):
        for name, parts, written, read in (("j", japanese, "shift_jis", "latin-1"), ("e", japanese, "euc_jp", "latin-1"), ("g", greek, "iso8859-7", "latin-1"), ("u", japanese, "utf-8", "gb18030")):
            a, b = rng.sample(parts, 2)
            try:
                wrong = a.encode(written).decode(read)
            except UnicodeError:
                continue
            truth[len(docs)] = name
            docs.append((len(docs), f"{wrong}\n{b} {k}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in garble.find_garbled(df, "doc_id", "text").collect()}
    assert got == set(truth), ([truth[i] for i in set(truth) - got], [docs[i] for i in got - set(truth)])


def test_long_items_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PART_WORDS", 52)
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for k, n in enumerate([500, 14, 13, 12, 53, 65, 66, 200])]
    docs = []
    for k, t in items:
        w = t.split()
        docs += [(1000 * k + s, "and then " + " ".join(w[s : s + 13]) + " at last") for s in range(0, max(len(w) - 12, 0), 3)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "eval_id long, text string")
    got = leaks.find_leaks(d, i, "doc_id", "text", "eval_id", "text", paraphrases=False)
    assert {(r.doc_id, r.eval_id) for r in got.collect()} == _copied(docs, items)


def test_inverted_index_finds_all_pairs_that_share_enough():
    rng = random.Random(8)
    passages = [[rng.choice([rng.randrange(12), rng.randrange(200)]) for _ in range(rng.randrange(13, 27))] for _ in range(300)]
    index = leaks.ItemIndex([0], [sum(passages, [])], {f"w{i}": i for i in range(200)}, np.ones(200), np.eye(200, dtype=np.float32), [], None, None, np.ones(200, dtype=bool))
    at = np.cumsum([0, *map(len, passages)]).tolist()
    index.passages = [(0, s, e) for s, e in zip(at, at[1:])]
    index.latent = leaks.project(passages, index.weights, index.basis)
    index.lengths = np.linalg.norm(index.latent, axis=1)
    for paraphrases in (False, True):
        searcher = leaks.Searcher(index, 0.25, paraphrases=paraphrases)
        parts = [np.array([w if rng.random() < 0.7 else -1 for w in p]) for p in passages[:60]]
        near = set(zip(*(x.tolist() for x in searcher.alike(parts))))
        for i, part in enumerate(parts):
            for k, other in enumerate(passages):
                mine, its = Counter(w for w in part.tolist() if w >= 0), Counter(other)
                assert (mine & its).total() < searcher.shared or (i, k) in near


def test_a_model_is_the_same_after_it_was_sent(spark):
    import pickle

    model = charmodel.train(spark.createDataFrame([(t,) for t in CLEAN * 3], "t string"), "t")
    dense = charmodel.CharModel(*[np.arange(1 << b, dtype=np.int64) * (1 << 30) for b in charmodel.BITS])
    for m in (model, dense):
        again = pickle.loads(pickle.dumps(m))
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip((m.tri, m.bi, m.uni, m.runs), (again.tri, again.bi, again.uni, again.runs))) and again.total == m.total
    assert len(pickle.dumps(model)) < 1_000_000


def test_model_and_margin_of_garbled_texts_come_from_all_records(spark, monkeypatch):
    docs, _ = _corpus()
    texts = {t for _, t in docs} | {f"plain text {i}" for i in range(50)}
    df = spark.createDataFrame([(t,) for t in [None, *sorted(texts), docs[0][1]]], "t string")
    fitted = garble.fit(df, "t")
    # Every record beyond ASCII is judged once as it is and once garbled, if a chain changes it.
    n = sum(not t.isascii() for t in texts)
    gains = fitted.gains.toPandas()
    stored, wrong = gains[gains.kind < 0].gain, gains[gains.kind >= 0].gain
    assert len(stored) == n and 0.9 * n <= len(wrong) <= n
    assert fitted.margin == garble.set_margin(stored.tolist(), wrong.tolist())
    # Each text begins at one edge that nothing else holds, and is counted.
    assert fitted.model.uni[ord(charmodel.EDGE)] == len(texts)
    # Gains that are known up to a bound give the same margin, also if it lies beyond the first one.
    monkeypatch.setattr(garble, "ENOUGH", 7.0)
    again = garble.fit(df, "t")
    assert again.margin == fitted.margin and again.gains.count() == len(gains)


def test_counts_by_fold_leave_the_fold_out(spark):
    texts = [(t, k % 3) for k, t in enumerate(CLEAN * 2)] + [(None, 1)]
    df = spark.createDataFrame(texts, "t string, fold int").repartition(2)
    by_fold = charmodel.counts(df, "t", None, "fold").cache()
    whole = charmodel.train(df, "t")
    for k in range(3):
        left = whole.without(charmodel.collected(by_fold.where(f"fold = {k}")))
        want = charmodel.train(df.where(f"fold <> {k}"), "t")
        assert all((a == b).all() for a, b in zip((left.tri, left.bi, left.uni, left.runs), (want.tri, want.bi, want.uni, want.runs)))
