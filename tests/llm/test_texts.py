"""Operators that take each text on its own: against the library, brute force and exact round trips."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, decontam, htmltext, langid, quality, secretscan, tokencounts
from tidemark.llm.queries import PLANTED
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def engine():
    with open(PATH, "rb") as f:
        return bpe.ByteBpe(f.read())


def expected_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# ---- op1, op7 ----


def test_encoder_equals_the_library(library, engine):
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "<|endoftext|>", "日本", "😀", "\x1c", "\x85", "\u200b", "\u0301", " the", "!", "...", "²"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 2000, "ab" * 2000, "", "\x00", *(t or "" for _, t, *_ in cases.rows())]
    for text, packed in zip(texts, engine.encode(texts), strict=True):
        assert bpe.ids_array(packed) == expected_ids(library, text)
        assert engine.decode(packed) == library.decode(bpe.ids_array(packed), skip_special_tokens=False) == text


def test_both_merging_ways_and_the_pair_test_agree(engine):
    r = random.Random(5)
    words = ["".join(r.choice("aehinrst ") for _ in range(r.randrange(1, 40))).encode() for _ in range(400)]
    for w in words:
        assert engine.merged(w) == engine._merged_long(w)
        guess = np.array(engine.guess(w))
        assert engine.compatible(guess[:-1], guess[1:]).all() == (guess.tolist() == engine.merged(w))


def test_encode_and_decode_tables(spark, library):
    docs = cases.docs(spark, extra=True)
    got = bpe.encode(docs, PATH, decoded="again").collect()
    assert sorted(((r.doc_id, r.again) for r in got), key=repr) == sorted(((i, t or "") for i, t, *_ in cases.rows()), key=repr)
    assert all(r.n_tokens == len(expected_ids(library, r.again)) and bpe.ids_array(r.ids) == expected_ids(library, r.again) for r in got)
    other = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "decoded").collect()
    assert sorted(map(repr, other)) == sorted(repr(r).replace("again", "decoded") for r in bpe.encode(docs, PATH, decoded="again").select("doc_id", "again").collect())
    assert bpe.encode(cases.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("common", [0, 3, 1 << 18])
def test_token_counts(spark, library, common):
    got = tokencounts.count(cases.docs(spark, extra=True), PATH, limit=100, common=common).collect()
    want = [(i, len((t or "").encode()), n := len(expected_ids(library, t)), n > 100) for i, t, *_ in cases.rows()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokencounts.count(cases.empty(spark), PATH).count() == 0
    once = [r for r in cases.rows()[:13]]  # no id twice
    alone = tokencounts.count(cases.docs(spark, False, once), PATH, limit=100, common=common).collect()
    assert sorted(map(tuple, alone), key=repr) == sorted([(i, len((t or "").encode()), n := len(expected_ids(library, t)), n > 100) for i, t, *_ in once], key=repr)


# ---- op5 ----


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(spark):
    some = [r for r in cases.rows() if r[1] is None or len(r[1]) < 50_000]
    some += [(100, prose := cases.prose(7, 40), "en", "s", 1), (101, prose + " " + cases.prose(8, 30) + " " + prose, "en", "s", 1)]
    got = quality.rules(cases.docs(spark, True, some)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *plain_rules(t)) for i, t, *_ in some), key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.rules(cases.empty(spark)).count() == 0


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    r = random.Random(1)
    base64 = lambda n: " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(n))
    invented = lambda n: " ".join("".join(r.choice(["an", "er", "th", "on", "re", "he", "in", "ed", "nd"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = {"prose": invented(200), "long prose": invented(4000), "noise": base64(40), "long noise": base64(400),
             "repetition": " ".join(f"w{i % 7} w{i % 5}" for i in range(400)), "prose with a key": invented(300) + " " + base64(1),
             "noise in the middle": invented(1000) + base64(120) + invented(1000)}
    got = {r.doc_id: r.kept for r in quality.rules(cases.docs(spark, some=[(i, t, "en", "s", 1) for i, t in enumerate(texts.values())])).collect()}
    assert dict(zip(texts, (got[i] for i in range(len(texts))), strict=True)) == {
        "prose": True, "long prose": True, "noise": False, "long noise": False, "repetition": False, "prose with a key": True, "noise in the middle": False}


def test_keep_returns_the_columns_of_its_input(spark):
    docs = cases.docs(spark, extra=True)
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    want = [r.doc_id for r in quality.rules(docs).collect() if r.kept]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


# ---- op2 ----


def test_language_profiles(spark):
    r = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["tion", "eau", "oui", "ment"]}
    say = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(i, say(lang, 80), lang, "s", 1) for i, lang in enumerate(list(parts) * 8)]
    test = [(100 + i, say(lang, n), lang, "s", 1) for i, (lang, n) in enumerate([(x, n) for x in parts for n in (2, 10, 200)])]
    learned = langid.profiles(cases.docs(spark, some=train), "text", "lang")
    assert sorted(learned) == ["aa", "bb", "cc"]
    got = langid.predict(cases.docs(spark, True, test), learned, carry={"lang": F.col("lang")}).collect()
    assert all(x.lang == x.lang_pred and 0 <= x.score <= 1 for x in got) and len(got) == len(test)
    odd = langid.predict(cases.docs(spark), learned).collect()
    assert len(odd) == len(cases.rows())
    for x in odd:
        text = next(t for i, t, *_ in cases.rows() if i == x.doc_id and (i is not None or (t is None) == (x.lang_pred == "und")))
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.profiles(cases.empty(spark), "text", "lang") == {}
    assert {x.lang_pred for x in langid.predict(cases.docs(spark), {}).collect()} == {"und"}


def test_large_alphabets_give_the_same_scores(monkeypatch):
    texts = ["".join(chr(0x4E00 + i * j % 900) for j in range(200)) for i in range(1, 6)] + ["", "abc"]
    prototypes = np.random.default_rng(3).normal(size=(3, 256))
    want = langid.score_texts(texts, ["a", "b", "c"], prototypes)
    monkeypatch.setattr(langid, "HELD", 64)
    assert langid.score_texts(texts, ["a", "b", "c"], prototypes) == want


def test_bundle_is_the_sum_of_bound_letters():
    owner, keys = langid.trigrams(["Ab c", "b"])
    assert owner.tolist() == [0, 0, 0, 1]
    v = langid.trigram_vectors(keys[:1], 256)[0]
    a, b = langid.letter_vector(ord("a"), 256), langid.letter_vector(ord("b"), 256)
    assert (v == np.roll(langid.letter_vector(0, 256), 2) * np.roll(a, 1) * b).all()


# ---- op4 ----


def test_blocks_of_untidy_pages():
    page = "<p>one &amp; two<br>three<p><b>four</b> five<script>var t='</p>';</script></p>six<!-- x > --><ul><li><a href='/x>y'>seven</a><li>eight</ul>it's &am"
    assert [b.text for b in htmltext.blocks(page)] == ["one & two three", "four five", "six", "seven", "eight", "it's &am"]
    assert [b.text for b in htmltext.blocks("<style>p{}")] == [] and htmltext.blocks("") == []
    assert [b.text for b in htmltext.blocks("<p>1 < 2 <3 & x</p><b" + "<a '" * 20_000 + "<div " * 20_000)] == ["1 < 2 <3 & x"]  # linear time
    assert [b.text for b in htmltext.blocks("<" * 20_000 + "a<!-- <p>")] == ["<" * 19_999]
    assert [b.text for b in htmltext.blocks("<p>one<br/>two<!--" + "<p>" * 20_000)] == ["one two"]


def test_end_tags_behind_letters_that_grow_in_lower_case():
    for tag in ("script", "STYLE", "Select"):
        page = f"<p>{'İ' * 40}</p><{tag}>x</{tag.swapcase()} ><p>whole paragraph</p><p>next</p>"
        assert [b.text for b in htmltext.blocks(page)] == ["İ" * 40, "whole paragraph", "next"]
    assert [b.text for b in htmltext.blocks("<script>x</scripts>y</ſcript></script\n><p>next")] == ["next"]


def test_controls_end_by_nesting():
    read = lambda page: [b.text for b in htmltext.blocks(page)]
    for tag in ("<svg width='1'/>", "<SVG/>", "<svg><path d='x'/>", "<svg><title/>", "<button>", "<object data=x/>", "<canvas>", "<select>", "<template>"):
        assert read(f"<article><p>one</p>{tag}<p>two</p></article><p>three</p>") == ["one", "two", "three"], tag
        assert [b.tags for b in htmltext.blocks(f"<article>{tag}<p>two</p></article>")] == [("article", "p")], tag
        assert read(f"<article><p>one</p>{tag}<p>two</p></article><p>three <button>x</button>") == ["one", "two", "three"], tag
    for tag in ("svg", "button", "object", "canvas", "select", "template"):
        assert read(f"<p>one<{tag} a='b'>x<g><q>y</q></g></{tag.upper()}> two <a>three</a></p>") == ["one two three"], tag
        assert read(f"<ul><li>a<{tag}>x</{tag}>b<li>c</ul></{tag}>") == ["a b", "c"], tag
    assert read("<p>one <object><p>x</p><ul><li>y</ul><canvas>z</object> two</p>") == ["one two"]
    assert read("<p>a</p><button>Share<p>b</p><p>c</p><button>More</button><p>d</p>") == ["a", "Share", "b", "c", "d"]
    assert read("<p>one <select><option>x<option>y</select> two <svg><foreignObject><p>z</p></foreignObject></svg></p>") == ["one two"]


def test_extraction_learns_layouts(spark):
    texts = [cases.prose(i, 25).capitalize() + "." for i in range(60)]
    pages = [f"<nav><ul><li><a href='/'>{texts[i][:9]}</a></ul></nav><article><h1>{texts[i][:30]}</h1><p>{texts[i + 1]}</p><p>{texts[i + 2]}</article><footer>&copy; {texts[i][:9]}</footer>" for i in range(50)]
    model = htmltext.train(htmltext.labelled(pages, 150))
    right = total = 0
    for seed in range(9000, 9060):
        page, labels = htmltext.layout(texts, seed)
        found = model.decode(htmltext.features(htmltext.blocks(page)))
        right, total = right + sum(a == b for a, b in zip(found, labels, strict=True)), total + len(labels)
    assert right > 0.97 * total
    rows = [(1, "u", pages[0], "x"), (1, "u", pages[0], "x"), (None, None, None, None), (3, "u", "", "x"), (4, "u", "<script>1", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, htmltext.extract(df, htmltext.fit(df)).collect()), key=repr)
    want = f"{texts[0][:30].strip()} {texts[1]} {texts[2]}"
    assert [g for g in got if g[0] == 1] == [(1, "u", want, len(want))] * 2
    assert [g[2:] for g in got if g[0] != 1] == [("", 0)] * 3
    none = spark.createDataFrame([], df.schema)
    assert htmltext.extract(none, htmltext.fit(none)).count() == 0


def test_viterbi_is_the_best_of_all_sequences():
    r = np.random.default_rng(1)
    chain = htmltext.Chain({str(i): i for i in range(6)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2))
    page = [[str(i)] for i in range(6)]
    score = lambda y: chain.start[y[0]] + chain.end[y[-1]] + sum(chain.state[i, c] for i, c in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:], strict=False))
    every = [[n >> i & 1 for i in range(6)] for n in range(64)]
    assert chain.decode(page) == max(every, key=score)


def test_articles_without_a_wrapper_are_found():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    model = htmltext.train(htmltext.labelled(pages[:120], 200))
    for page in pages[120:]:
        found = htmltext.blocks(page)
        want = " ".join(b.text for b in found if "article" in b.tags and not htmltext.ASIDE & {*b.tags, *b.names})
        for changed in (page, re.sub(r"</?article[^>]*>", "", page), page.replace("<article", "<main").replace("</article", "</main")):
            assert htmltext.main_text(changed, model) == want


def test_training_climbs_to_the_enumerated_optimum():
    """No step in any weight raises the penalised likelihood, with the sum over all labellings written out."""
    from itertools import product

    r = random.Random(2)
    pages = [([[r.choice("abc") for _ in range(2)] for _ in range(n)], [r.randrange(2) for _ in range(n)]) for n in (1, 3, 4, 2, 4)]
    decay = 0.05
    model = htmltext.train(pages, rounds=4000, rate=0.02, decay=decay)

    def value(m):
        total = 0.0
        for x, y in pages:
            s = m.scores(x)
            score = lambda y: m.start[y[0]] + m.end[y[-1]] + sum(s[i, c] for i, c in enumerate(y)) + sum(m.move[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
            total += score(y) - np.logaddexp.reduce([score(z) for z in product((0, 1), repeat=len(y))])
        return total / len(pages) - decay / 2 * sum((w**2).sum() for w in (m.state, m.move, m.start, m.end))

    best = value(model)
    for weights in (model.state, model.move, model.start, model.end):
        for at in np.ndindex(weights.shape):
            for step in (-0.02, 0.02):
                weights[at] += step
                assert value(model) < best
                weights[at] -= step


def test_training_pages_are_different_ones_by_hash(spark):
    page = "<html><body><article><p>some text of words here</p></article><div class='menu'><a href='/'>x</a></div></body></html>"
    rows = [(i, "u", page) for i in range(50)] + [(100 + i, "u", page.replace("words", f"words{i}")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    seen = []
    original = htmltext.labelled
    try:
        htmltext.labelled = lambda pages, n: seen.append(pages) or original(pages, n)
        htmltext.fit(df, sample=5)
        htmltext.fit(df.repartition(2), sample=5)
    finally:
        htmltext.labelled = original
    assert seen[0] == seen[1] and len(set(seen[0])) == len(seen[0]) == 5


# ---- op8 ----


def said(messages):
    return [(r.conv_id, r.role, r.text) for r in messages.orderBy("conv_id", "seq", "message").collect()]


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, "a", 1, "start", "user", None), (1, "a", 2, "delta", None, "hel"), (1, "a", 3, "delta", None, "lo"), (1, "a", 3, "delta", None, "lo"),
           (1, "b", 4, "start", "assistant", None), (1, "b", 5, "delta", None, "bad"), (1, "b", 6, "regenerate", None, None), (1, "b", 8, "delta", None, "od"), (1, "b", 7, "delta", None, "go"),
           (1, "c", 9, "start", "user", "x"), (1, "c", 10, "delete", None, None), (1, "a", 11, "edit", None, "hi"), (1, "a", 12, "delta", None, "!"), (None, "z", 1, "start", None, "q")]
    events = spark.createDataFrame(log, "conv_id long, message string, seq long, kind string, role string, text string")
    assert said(chat.fold(events)) == [(None, None, "q"), (1, "user", "hi!"), (1, "assistant", "good")]
    assert said(chat.fold(events.limit(0))) == []


def plain_fold(log):
    """Final messages, event by event."""
    out = {}
    for conv, message, seq, kind, role, text in sorted(
            set(log), key=lambda x: (-(10**9) if x[2] is None else x[2], (x[3] or "delta") not in chat.RESETS, x[5] or "")):
        m = out.setdefault((conv, message), {"first": seq, "role": None, "text": "", "gone": False})
        if role is not None:
            m["role"] = role
        m["gone"] |= kind == "delete"
        m["text"] = (text or "") if kind in chat.RESETS else m["text"] + (text or "")
    return sorted(((c, m["role"], m["text"]) for (c, _), m in out.items() if not m["gone"]), key=repr)


def test_fold_equals_playing_the_log(spark):
    r = random.Random(11)
    log = [(r.choice([1, 2, None]), r.choice(["a", "b", None]), seq if r.random() < 0.8 else None, r.choice(["start", "delta", "delta", "delta", "edit", "regenerate", None]), f"role{seq}" if r.random() < 0.3 else None,
            r.choice([None, "", "x", "yy"])) for seq in range(70)]
    # One reset only among the rows without a place, which are ordered by kind and text.
    log = [x for x in log if not (x[2] is None and (x[3] in chat.RESETS or x[4]))] + [(1, "a", None, "start", "user", "first"), (3, "c", None, "delta", "user", "only"), (3, "d", 1, "delete", None, None)]
    log += r.sample(log, 10)
    events = spark.createDataFrame(log, "conv_id long, message string, seq long, kind string, role string, text string")
    assert sorted(((x.conv_id, x.role, x.text) for x in chat.fold(events).collect()), key=repr) == plain_fold(log)


def test_rows_without_a_turn_come_first_and_keep_their_role(spark):
    rows = [(1, 0, "user", "q"), (1, None, "assistant", "hello"), (1, None, "assistant", None), (1, 1, "assistant", "bye"), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.read_back(chat.render(chat.fold(chat.events_of(df)))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("assistant\n\nassistant\nhello\nuser\nq\nassistant\nbye\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 8, sha("hellobye")) and got[2].turns_sha256 == sha("\nx\n")


def test_formatting_is_reversible(spark):
    texts = [None, "", "\\", "\\\\", "###", "### Assistant: ", "</turn>", "\\</turn>\n", "a:b\\:c", PLANTED, "x" * 50_000, "a\nb", "\\### \\</turn>\\"]
    rows = [(i // 5, i % 5, role, t) for i, t in enumerate(texts) for role in ("user", "assistant", "a:\\###</turn>")] + [(9, 0, None, "no role"), (9, 0, None, "no role"), (9, 7, "assistant", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1)).withColumn("seq", F.lit(2))
    formatted = chat.render(chat.fold(chat.events_of(df)))
    whole = {}
    for r in formatted.orderBy("conv_id", "seq", "message").collect():
        whole.setdefault(r.conv_id, []).append(r.formatted)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv, parts in whole.items():
        mine = sorted((x for x in rows if x[0] == conv), key=key)
        assert [*chat.turns_of("".join(parts))] == [(x[2] or "", x[3] or "") for x in mine]
    for r in chat.read_back(formatted).collect():
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=key)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine) and r.formatted_chars == sum(map(len, whole[r.conv_id]))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.render(chat.fold(chat.events_of(df.limit(0))))).count() == 0


# ---- op9 ----


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, places, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                places |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(places), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(places)


@pytest.mark.parametrize("block_words", [10, 1 << 20])
def test_decontamination(spark, block_words):
    items = [(1, cases.prose(50, 30)), (2, cases.prose(51, 10)), (12, cases.prose(52, 9)), (3, "two words"), (4, None), (5, ""), (6, "..."), (None, cases.prose(53, 12)),
             (7, "the " * 15), (8, cases.prose(50, 30)), (1, cases.prose(50, 30))]
    r = random.Random(4)
    planted = []
    for k in range(60):
        w = r.choice(items)[1] or ""
        cut = w.split()[r.randrange(3) :][: r.randrange(8, 14)]
        planted.append((200 + k, cases.prose(k, 12) + " " + ("; ".join(cut).title() if k % 2 else " ".join(cut)) + " " + cases.prose(k + 1, r.randrange(9)), "en", "s", 1))
    docs = cases.rows() + planted
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.digest(decontam.hits(cases.docs(spark, True, docs), bench, block_words=block_words)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain_hits(t, items)) for i, t, *_ in docs), key=repr)
    kept = decontam.clean(cases.docs(spark, True, docs), bench, block_words=block_words)
    assert kept.columns == cases.docs(spark, True).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, t, *_ in docs if not plain_hits(t, items)[-1]), key=repr)
    assert decontam.digest(decontam.hits(cases.empty(spark), bench)).count() == 0
    assert not decontam.digest(decontam.hits(cases.docs(spark), bench.limit(0))).where("contaminated").count()


# ---- op10 ----


def plain_base(text):
    text, out = text or "", []
    ascii_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = "(" + "|".join(map(ascii_case, ("password", "passwd", "secret", "token"))) + "|" + ascii_case("api") + "_?" + ascii_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out)), [k for *_, k in out]


def test_secret_scan(spark):
    r = random.Random(6)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(a) for _ in range(n))
    texts = ["Token = 'abc' secret: abcdef", "secret=token: abcdefgh", "PASSWORD:\"x.y/z=\" é api_key=123456 APIkey = 12345", "AKIA" + "B" * 15, "é AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 13,
             "0123456789abcdef01234567", "x0123456789abcdef0123456g", "to\u212aen = abcdefgh pa\u017fsword=abcdefgh", f"token={key(40, '0123456789abcdef')}", f"see {key(40)} and {key(64)}",
             "a-very-long-file-name-2024-without-any-secret another_long_identifier_number_12 " + "ab1" * 20]
    rows = [(50 + i, t, "en", "s", 1) for i, t in enumerate(texts)] + cases.rows()
    got = secretscan.digest(secretscan.scan(cases.docs(spark, True, rows))).collect()
    want = sorted(((i, *(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(s.encode()).hexdigest()) for i, (s, kinds) in ((i, plain_base(t)) for i, t, *_ in rows)), key=repr)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == want
    spans = {r.doc_id: r.spans for r in got}
    assert spans[59].count("random:") == 2 and "random" not in spans[60]
    for i, t, *_ in rows:
        if i is not None:
            assert [s for s in spans[i].split(",") if not s.startswith("random")] == plain_base(t)[0].split(",") or not plain_base(t)[0]
    assert secretscan.digest(secretscan.scan(cases.empty(spark))).count() == 0


def test_secret_scan_of_names_paths_and_single_classes(spark):
    r = random.Random(14)
    key = lambda n, a: "".join(r.choice(a) for _ in range(n))
    base62 = secretscan.UPPER + secretscan.LOWER + secretscan.DIGITS
    # Texts with {} where the one random span belongs.
    keys = [("DB_PASS={}", key(32, base62)), ("auth={} next", key(32, base62)), ("a={}", key(33, base62) + "="), ("={}", key(22, base62) + "=="), ("x/my-app_v2/{}/end", key(36, base62)),
            ("api/hooks/services/of/words/{}", key(36, base62)), ("lower {}", key(40, secretscan.LOWER)), ("upper {}", key(40, secretscan.UPPER)), ("n {}", key(22, secretscan.DIGITS)),
            ("letters {}", key(40, secretscan.UPPER + secretscan.LOWER)), ("mixed {}", key(12, base62) + "+" + key(12, base62) + "-" + key(16, base62)), ("DIR=0123456789abcdef01234567/{}", key(36, base62))]
    plain = ["internationalization counterrevolutionaries Donaudampfschifffahrtsgesellschaft electroencephalographically", "DATABASE_CONNECTION=usr/local/share-of/some_library/of-things/paths",
             "=" * 40 + " " + "-" * 40 + " " + "_=" * 20 + " 00000000000000000000 12345678901234567890", "AbstractSingletonProxyFactoryBean Access-Control-Allow-Origin MAXIMUM_LINE_LENGTH_OF_TEXT"]
    texts = [t.format(k) for t, k in keys] + plain
    got = {x.doc_id: x.spans for x in secretscan.digest(secretscan.scan(cases.docs(spark, some=[(i, t, "en", "s", 1) for i, t in enumerate(texts)]))).collect()}
    for i, (t, k) in enumerate(keys):
        assert [s for s in got[i].split(",") if s.startswith("random")] == [f"random:{(at := t.index('{}'))}:{at + len(k)}"], t
    assert [got[len(keys) + i] for i in range(len(plain))] == [""] * len(plain)


def test_battery_separates_draws_from_structure():
    r = random.Random(8)
    draws = {name: ["".join(r.choice(a) for _ in range(40)) for _ in range(300)] for name, a in secretscan.ENCODINGS}
    for name, alphabet in secretscan.ENCODINGS:
        p = np.array([secretscan.p_value(t, alphabet) for t in draws[name]])
        assert (p < 0.05).mean() < 0.12  # close to the level of the tests, or below
    for token in ("abababababababababab1", "aaaaaaaaaaaaaaaaaaaaaaaa1", "the-quick-brown-fox-jumps-over-1-lazy-dog"):
        kind = secretscan.encoding_of(token)
        assert kind and secretscan.p_value(token, kind[1]) < 0.02


def test_limits_follow_benjamini_and_hochberg():
    b = secretscan.Battery(q=0.1, floor=0.001)
    assert secretscan.limits([("hex", 9, c, 10) for c in range(5)], b) == {("hex", 9): 0.001}  # nothing looks structured
    found = secretscan.limits([("hex", 9, 20, 90), ("hex", 9, 0, 10), ("hex", 11, 13, 1), ("hex", 12, 300, 9), ("hex", 12, 5, 1)], b)
    assert found == {("hex", 9): 0.01, ("hex", 11): 10 ** -1.3, ("hex", 12): 0.001}
