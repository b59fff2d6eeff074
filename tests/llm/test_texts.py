import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import abuse, leaks, tokens

DOC = "doc_id long, text string, source string, lang string, eval_id string, ids int, _text int, category string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["a", None][i % 2], "en", "x", 1, 2, "c") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return tokens.Encoder(tokens.vocabulary_path())


def reference():
    tok = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tok.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


HARD = ["", " ", "   a  b\n\n c", "don't we'll I'm", "naïve café Größe 東京 🙂👍", "<|endoftext|>", "a" * 5000, "\u200bx\ufeff\x00\r\n\t", "ab" * 3000 + "!" * 300, "'S 'LL ١٢٣", "é" * 700]


def test_ids_equal_the_public_tokenizer(spark, encoder):
    t = reference()
    for text in HARD:
        assert encoder.ids(text) == t.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in tokens.encoded(docs(spark, [*HARD, None])).collect()}
    assert got[len(HARD)] is None and got[0] == [] and [got[i] for i in range(len(HARD))] == [encoder.ids(x) for x in HARD]
    assert tokens.encoded(docs(spark, [])).count() == 0
    counts = {r.source: (r.n_texts, r.n_tokens) for r in tokens.token_counts(docs(spark, [*HARD, None])).collect()}
    assert sum(n for n, _ in counts.values()) == len(HARD) + 1 and sum(n for _, n in counts.values()) == sum(len(encoder.ids(x)) for x in HARD)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    pytest.importorskip("public_tokenizers")
    e = tokens.Encoder(tokens.vocabulary_path())
    ids = e.ids(text)
    back = {v: k for k, v in e.ranks.items()}
    assert b"".join(back[i] for i in ids) == text.encode()
    assert ids == reference().encode(text, add_special_tokens=False).ids


def naive(text, passages, words=10):
    w = leaks.plain_words(text or "")
    have = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    return {k for k, p in passages if any(tuple(q[i : i + words]) in have for q in [leaks.plain_words(p or "")] for i in range(len(q) - words + 1))}


def test_leaks_against_brute_force(spark):
    rng = random.Random(0)
    vocab = ["a", "an", "ant", "ante", "is", "it", "Größe", "café", "x1", "77", "the", "then"]
    passages = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30)))) for k in range(20)] + [(98, None), (99, "")]
    texts = [None, "", "one two"]
    for _ in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        k, p = rng.choice(passages[:20])
        q = p.split()
        n = rng.randint(8, 12)
        at = rng.randint(0, max(0, len(q) - n))
        texts.append(" ".join(body[: len(body) // 2] + q[at : at + n] + body[len(body) // 2 :]))
    items = spark.createDataFrame([(k, p, 5) for k, p in passages], "eval_id long, passage string, doc_id int")
    got = leaks.passage_leaks(docs(spark, texts), items).collect()
    want = {(d, k) for d, t in enumerate(texts) for k in naive(t, passages)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 50
    assert leaks.passage_leaks(docs(spark, texts), items.limit(0)).count() == 0
    assert leaks.passage_leaks(docs(spark, []), items).count() == 0


def test_spelling_does_not_hide_a_leak():
    p = "Between Greywold and the Straße stood 54 old towers; a naïve painter came"
    w = leaks.WuManber(leaks.passage_windows([(1, p)]))
    hidden = ["BETWEEN GREYWOLD AND THE STRASSE STOOD 54 OLD TOWERS A NAIVE", "so between  grey\u200bwold,\nand the strasse: stood <b>54</b> old towers &amp; a nai\u0308ve", "_Between_ *Greywold*-and-the-straße-stood-54-old-towers-a"]
    assert all(leaks.leaked_items(t, w) == {1} for t in hidden)
    clear = ["between greywold and the strasse stood 54 old", "xbetween greywold and the strasse stood 54 old towers an", "between greywold and the strasse stood 55 old towers a naive painter came"]
    assert not any(leaks.leaked_items(t, w) for t in clear)
    assert leaks.leaked_items("z " * 50_000 + hidden[0] + " y" * 50_000, w) == {1}


def test_long_markup_does_not_hide_a_leak():
    p = "between greywold and the strasse stood 54 old towers a naive painter came"
    w = leaks.WuManber(leaks.passage_windows([(1, p)]))
    head, tail = p[:38], p[38:]
    tag, comment = f'<a href="https://example.org/{"path/" * 200}">', f"<!-- {'some note > ' * 100}-->"
    for t in (head + tag + tail, head + comment + tail, head + tag + comment + tail, f"if a <b then {p} {'x ' * 200} > c", f"<!-- {p} {'x ' * 400} -->", f"<!-- {head}{tag}{tail} {'x ' * 400} -->"):
        assert leaks.leaked_items(t, w) == {1}
    assert not leaks.leaked_items(head + " other words " + tail, w)
    assert leaks.passage_windows([(1, head + tag + tail)]).keys() >= leaks.passage_windows([(1, p)]).keys()
    assert leaks.leaked_items("<a " * 50_000 + "<!--" * 20_000 + p, w) == {1}


def test_disguises_are_undone():
    assert abuse.sentences("You are a d1r7b4g. An i d i o t!") == ["you are a dirtbag", "an idiot"]
    assert abuse.sentences("p a y a s o   i n ú t i l") == ["payaso   inutil"]
    assert abuse.sentences("mo\u200bron &amp; ІMBЕСІLЕ; S*****G") == ["moron & imbecile", "s*g7"]
    assert abuse.sentences("a.b.r.u.t.i") == ["abruti"]
    assert [abuse.sentences(t) for t in (None, "", "  \n ")] == [[], [], []]
    assert len(abuse.features("")) == 0


def made_up(n, seed):
    """Reviews of plain sentences, some with a sentence of one of three invented kinds; labels with a little noise."""
    rng = np.random.default_rng(seed)
    things, bad = ["lamp", "tent", "drill", "hose", "phone"], {0: "you are a total {} seller", 1: "all {} people must leave our town", 2: "i saw {} naked on the sofa"}
    words = ["glorp", "flimb", "snarg", "brock"]
    texts, y = [], np.zeros((n, 3))
    for i in range(n):
        s = [f"the {rng.choice(things)} works after {rng.integers(2, 60)} days" for _ in range(rng.integers(1, 9))]
        for c in range(3):
            if rng.random() < 0.15:
                s.insert(rng.integers(0, len(s) + 1), bad[c].format(rng.choice(words)))
                y[i, c] = 1
        texts.append(". ".join(s))
    return texts, y


def test_model_finds_documents_and_sentences(spark):
    texts, y = made_up(500, 0)
    noisy = np.where(np.random.default_rng(1).random(y.shape) < 0.03, 1 - y, y)
    noisy[:20, 1] = np.nan
    model = abuse.NoisyOr.fit(texts, noisy)
    held, truth = made_up(300, 9)
    got = abuse.scored(docs(spark, [*held, None, "", " "]), model).toPandas().sort_values("doc_id")
    flags = got[list(abuse.CATEGORIES)].to_numpy()[: len(held)] >= 0.5
    assert (flags == truth.astype(bool)).mean() > 0.98
    assert (got[list(abuse.CATEGORIES)].to_numpy()[len(held) :] == 0).all() and got["worst_abusive"].iloc[-1] is None
    hit = got["worst_sexual"].to_numpy()[: len(held)][truth[:, 2] == 1]
    assert np.mean(["naked" in s for s in hit]) > 0.98
    f = abuse.flagged(abuse.scored(docs(spark, held), model), 0.5)
    assert f.count() == flags.sum()
    rates = abuse.source_rates(abuse.scored(docs(spark, held), model), 0.5)
    assert {r.source for r in rates.collect()} == {"a", "(none)"}


def test_without_labels_nothing_is_flagged(spark):
    labels = spark.createDataFrame([], "doc_id long, rater string, abusive int, hateful int, sexual int")
    d = docs(spark, ["some text", None])
    assert abuse.flagged(abuse.scored(d, abuse.fitted(d, labels))).count() == 0
