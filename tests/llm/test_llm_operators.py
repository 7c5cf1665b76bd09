"""The ten operators against brute force, on planted cases and on odd tables."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import (
    decontaminate,
    html_text,
    language_id,
    lm_score,
    ngram_join,
    packing,
    quality_qda,
    quality_rules,
    registered,
    secret_scan,
    url_filter,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, secrets string, score double"
SMALL = "/root/testdata/sf0.001"


def frame(spark, texts, langs=None, first=0):
    langs = langs or ["en"] * len(texts)
    rows = [(first + i, t, lang, "s", len(t or ""), "x", 0.5) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, no words, odd characters."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", " \n\t", "one", "one two", "a b c d e f g", "a b c d e f g", long, long, "é\u00a0ß 'tis don't\x1cx", "12 !! ..", "\U0001f600 x"]
    rows = frame(spark, texts)
    return rows.union(rows.filter("doc_id = 5"))


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_html_keeps_the_article_alone():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies for many things on this site and others</div>"
        "<main><article><h1>A &amp; B</h1><p>One <b>two</b>\n three&nbsp;four.<p>Next <a href=y>link</a><script>if(a<b)x='</p>'</script> end.</p>"
        "<div class='comments'><p>A reader says that this is a fine article indeed</p></div><form><label>Name</label></form></article></main>"
        "<aside>Related things to read on other days</aside><footer>&copy; me</footer></body></html>"
    )
    assert html_text.extract(page) == "A & B One two three four. Next link end."
    assert [html_text.extract(x) for x in ("", "<!-- x", "<script>abc", "<p></p>")] == [""] * 4
    assert html_text.extract("<article>" + "<p>some words</p>" * 20_000).count("words") == 20_000


def test_html_query_gives_whole_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in registered.op1_html_extraction(spark, SMALL).collect()}
    import html

    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        want = html.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        assert got[page.page_id].text.split() == want and got[page.page_id].n_chars == len(got[page.page_id].text)
    nulls = spark.createDataFrame([(1, "u", None), (1, "u", None)], "page_id int, url string, html string")
    assert [r.main.text for r in html_text.extract_text(nulls).collect()] == ["", ""]


def test_secret_models_tell_random_strings_from_names():
    held_out = secret_scan.labelled_samples(100, seed=11)
    model = secret_scan.trained()
    assert np.mean([model.is_random(text) == bool(label) for text, label in held_out]) > 0.99


def test_secret_base_spans():
    text = "API_key: 'ab' token=\"abc-def123\" x AKIA" + "Q" * 16 + " " + "0a" * 12 + " Password :  hunter22; pa\u017f\u017fwd=notascii"
    got = secret_scan.base_spans(text)
    assert [(text[a:b], k) for a, b, k in got] == [
        ('token="abc-def123', "assign"),
        ("AKIA" + "Q" * 16, "access"),
        ("0a" * 12, "hex"),
        ("Password :  hunter22", "assign"),
    ]
    nested = "token=token: abcdefgh"
    assert secret_scan.base_spans(nested) == []  # the failing match has taken the second keyword


def test_secret_query_and_redaction(spark, odd, empty):
    secret = "x" + "9fQ2zLr7Kp0VwXyT3mB8" + "aZ1"
    docs = frame(spark, [f"key {secret} end", "plain words only", None, "token = " + "ab12" * 10])
    found = {r.doc_id: r.secrets for r in secret_scan.find_secrets(docs).collect()}
    assert found[0].kinds == ["model"] and found[1].kinds == [] and found[2].kinds == [] and found[3].kinds == ["assign", "hex"]
    assert found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert clean[0].text == "key [secret] end" and clean[0].n_chars == 16 and clean[2].text is None and clean[3].text == "[secret]"
    assert clean[1].text == "plain words only" and secret_scan.redact(docs).columns == docs.columns
    assert secret_scan.redact(odd).count() == odd.count() and secret_scan.redact(empty).count() == 0


def test_secrets_beside_base_spans_in_one_run():
    model, key = secret_scan.trained(), "9fQ2zLr7Kp0VwXyT3mB8aZ1x9fQ7zLr2Kp5VwXyT"
    hex_, access = "0a1b" * 8, "AKIA" + "Q7" * 8
    for text in (f"see https://h/{hex_}/{key} end", f"{access}/{key}", f"{key}/{hex_}", f"{key}/{hex_}/{key}"):
        base, spans = secret_scan.scan(text, model)
        assert len(base) == 1
        covered = {i for start, end, _ in spans for i in range(start, end)}
        places = [m.start() for m in re.finditer(key, text)]
        assert all(covered >= set(range(at, at + len(key))) for at in places) and len(spans) == 1 + len(places)
    assert [k for *_, k in secret_scan.scan(f"/{hex_}/short", model)[1]] == ["hex"]


def test_language_models_on_held_out_rows(spark):
    got = registered.op3_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())


def test_language_model_is_a_distribution():
    columns, _ = language_id.grams(["the cat sat on the mat and that was that", "another text there"])
    kinds, _, number = language_id.distinct(columns)
    model = language_id.KneserNey(kinds, number)
    letters = np.unique(columns[3])
    for context in ("the", "at ", "zzz"):
        rows = np.array([[*map(ord, context), c] for c in letters]).T.astype(np.uint32)
        rest = model.uniform  # of the one character that stands for all unseen ones
        assert 0.9 < model.chance(rows).sum() <= 1 + 1e-9 and rest > 0


def test_language_rejection_is_calibrated(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = docs.filter("crc32(cast(doc_id as string)) % 3 = 1 and text rlike '[a-zA-Z]'")
    learn = docs.filter("crc32(cast(doc_id as string)) % 3 != 1")
    wrong = language_id.identify(held, language_id.fit(learn)).filter("language.rejected").count()
    assert wrong <= 0.01 * held.count()
    foreign = held.filter("lang = 'de'")
    passed = language_id.identify(foreign, language_id.fit(learn.filter("lang != 'de'"))).filter("not language.rejected").count()
    assert passed <= 0.1 * foreign.count()
    assert language_id.bound([float(x) for x in range(1999)]) == 1997.0 and language_id.bound([float(x) for x in range(999)]) == 998.0
    assert language_id.bound([1.0, 2.0]) == language_id.FEW_DEVIATIONS and language_id.bound([1.0, 20.0]) == 20.0
    assert language_id.bound([]) == language_id.FEW_DEVIATIONS


def test_language_samples_share_no_text(spark):
    rows = [(i // 7, f"text number {i % 150} of a few", "en") for i in range(600)]
    some = language_id.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1000)
    sides = {side: {r.text for r in some.filter(f"apart = {side}").collect()} for side in ("true", "false")}
    assert sides["true"] and sides["false"] and not sides["true"] & sides["false"] and some.count() == 600


def test_language_id_on_odd_tables(spark, odd, empty):
    models = language_id.fit(frame(spark, ["le chat est la " * 9, "the cat is here " * 9, None, "123"], ["fr", "en", "en", None]))
    out = rows_of(language_id.identify(odd, models).select("doc_id", "language.lang", "language.score", "language.rejected"))
    assert len(out) == 13 and {r[0] for r in out if r[1] == "und"} == {0, 1, 2, 10} and all(r[3] for r in out if r[1] == "und")
    assert language_id.identify(empty, models).count() == 0
    none = language_id.identify(odd, language_id.fit(empty)).select("language.lang").distinct().collect()
    assert [r.lang for r in none] == ["und"]


def test_lm_query_equals_counts(spark):
    texts = {r.doc_id: words(r.text) + ["\n"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    learn = Counter(w for i, own in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    total = learn.total()
    lm_score.COMMON_WORDS, before = 50, lm_score.COMMON_WORDS  # most words then go by the join
    try:
        got = registered.op4_lm_scoring(spark, SMALL).collect()
    finally:
        lm_score.COMMON_WORDS = before
    assert len(got) == len(texts)
    for r in got:
        own = texts[r.doc_id]
        base = sum(np.log10((learn[w] + 1) / (total + len(learn) + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in learn for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -1e7 < r.score < 0


def test_lm_counts_words_in_every_step_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "STEP_BYTES", 400)
    docs = frame(spark, [f"The c\u00e4t No{i}  SAT on {i % 7}! " * (1 + i % 5) for i in range(90)]).coalesce(1)  # without nulls
    own = {r.doc_id: words(r.text) + ["\n"] for r in docs.collect()}
    seen = Counter(w for tokens in own.values() for w in tokens)
    counts = lm_score.settled(lm_score.word_counts(docs), "test")
    assert {r.word: r.n for r in counts.collect()} == seen
    got = lm_score.score(docs, counts, lm_score.Attention([])).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in got} == {i: (len(tokens), len(tokens)) for i, tokens in own.items()}
    for r in got:
        assert r.base_score == pytest.approx(sum(np.log10((seen[w] + 1) / (seen.total() + len(seen) + 1)) for w in own[r.doc_id]), rel=1e-9)


def test_attention_scores_are_causal_and_sum_to_one():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 300, n) for n in (0, 1, 31, 32, 33, 200)]
    model = lm_score.Attention(ids)
    scores = model.score(ids, at_once=3)
    for own, score in zip(ids, scores, strict=True):  # by single steps without batches
        alone = 0.0
        full = np.r_[own, lm_score.END]
        inputs, targets, *_ = lm_score.windows([own])
        for w in range(len(inputs)):
            logits = model.forward(inputs[w : w + 1])[-1][0]
            assert np.allclose(np.exp(logits).sum(axis=1), 1, atol=1e-4)
            alone += sum(logits[t, model.classes[x]] + model.share[x] for t, x in enumerate(targets[w]) if x >= 0)
        assert score == pytest.approx(alone, rel=1e-4)
        assert (targets[targets >= 0] == full).all()  # each id once
    by_class = np.bincount(model.classes, np.exp(model.share), lm_score.CLASSES)
    assert np.allclose(by_class[by_class > 0], 1, atol=1e-3)
    inputs, *_ = lm_score.windows([ids[5]])
    changed = inputs.copy()
    changed[1, lm_score.CONTEXT + 11 :] = 5
    a, b = model.forward(inputs[1:2])[-1], model.forward(changed[1:2])[-1]
    assert np.allclose(a[0, :11], b[0, :11], atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 200, n) for n in (0, 1, 31, 32, 33, 150)]
    model = lm_score.Attention(ids)
    model.p = {name: value.astype(float) for name, value in model.p.items()}
    inputs, targets, *_ = lm_score.windows(ids)
    w, t = np.nonzero(targets >= 0)

    def loss():
        return -model.forward(inputs)[-1][w, t, model.classes[targets[w, t]]].mean(dtype=float)

    rows, grads = model.gradients(inputs, targets)
    for name, grad in grads.items():
        at = rows if name == "e" else slice(None)
        way = rng.normal(size=grad.shape) + 5 * grad / np.abs(grad).max()
        was = model.p[name].copy()
        model.p[name][at] = was[at] + 1e-3 * way
        more = loss()
        model.p[name][at] = was[at] - 1e-3 * way
        less = loss()
        model.p[name] = was
        assert (more - less) / 2e-3 == pytest.approx(float((grad * way).sum()), rel=0.02, abs=1e-3), name


def test_ids_of_parts_met_lately_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_PARTS", 40)
    ids, asked = packing.PartIds(packing.default_tokenizer()), Counter()
    tokens = ids.tokens
    ids.tokens = lambda part: asked.update([part]) or tokens(part)
    common = ["cat", "sat", "mat", "caf\u00e9", "7", "'s"]
    for turn in range(40):
        texts = [" ".join([*common, f"rare{chr(97 + turn % 26)}{'x' * (1 + turn // 26)}{name}"]) for name in ("abc", "bcd", "cde")]
        for text, own in zip(texts, ids.of([text.encode() for text in texts]), strict=True):
            assert own.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(ids.kept) + len(ids.earlier) <= 40 + len(common)  # the parts of the step at hand may be in both
    assert len(asked) > 120 and max(asked.values()) == 1  # not once more when others fill the room


def test_shares_that_follow_the_text_sum_to_one():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 700, n) for n in (50, 400, 900)]
    model = lm_score.Attention(ids)
    number = lm_score.CLASSES * lm_score.GROUPS
    pairs = np.zeros((number, number))
    for own in ids:
        of = model.groups[np.r_[lm_score.BEGIN, own, lm_score.END]]
        np.add.at(pairs, (of[:-1], of[1:]), 1)
    plain = model.score(ids)
    model.follow(pairs)
    assert (model.score(ids) > plain).all()
    for before in (lm_score.BEGIN, int(ids[0][0]), 699, 40_000):  # whatever the id before, also one not met
        chance = np.exp(model.share + model.shift[model.groups[before], model.groups].astype(float))
        by_class = np.bincount(model.classes, chance, lm_score.CLASSES)
        assert np.allclose(by_class[np.bincount(model.classes, minlength=lm_score.CLASSES) > 0], 1, atol=1e-3)
    for own, score in zip(ids, model.score(ids), strict=True):  # each place by itself
        inputs, targets, *_ = lm_score.windows([own])
        alone = 0.0
        for w, t in np.argwhere(targets >= 0):
            to, before = targets[w, t], inputs[w, lm_score.CONTEXT + t]
            logits = model.forward(inputs[w : w + 1])[-1][0, t]
            alone += logits[model.classes[to]] + model.share[to] + model.shift[model.groups[before], model.groups[to]]
        assert score == pytest.approx(alone, rel=1e-4)


def test_lm_scores_of_pieces_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 2 * lm_score.BLOCK)
    monkeypatch.setattr(lm_score, "FAN", 2)  # sums over several steps
    texts = ["the cat sat on the mat " * 60 + "zebra crossing " * 40, "one two", "", None, "one two", "the mat " * 33] * 3
    docs = spark.createDataFrame([(i % 5 or None, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(7)
    cut_texts = lm_score.settled(lm_score.pieces(docs), "test")
    seen, own = lm_score.gathered(cut_texts), packing.part_ids(packing.default_tokenizer()).of([(x or "").encode() for x in texts])
    assert np.array_equal(seen, lm_score.neighbours([(x, True, True) for x in own]))
    model = lm_score.train_on(cut_texts)
    pairs = Counter()
    for x in own:
        pairs.update(zip(model.groups[np.r_[lm_score.BEGIN, x]].tolist(), model.groups[np.r_[x, lm_score.END]].tolist(), strict=True))
    found = lm_score.group_pairs(cut_texts, model)
    assert found.sum() == pairs.total() and all(found[pair] == n for pair, n in pairs.items())
    counts = lm_score.settled(lm_score.word_counts(docs), "test")
    want = Counter((i % 5 or None, round(float(nats / np.log(10)), 2)) for i, nats in enumerate(model.score(own)))
    assert Counter((r.doc_id, round(r.score, 2)) for r in lm_score.score(docs, counts, model).collect()) == want


def test_lm_on_odd_tables(spark, odd, empty):
    counts = lm_score.settled(lm_score.word_counts(odd), "test")
    model = lm_score.train(odd)
    out = lm_score.score(odd, counts, model).collect()
    assert len(out) == 13 and {r.n_tokens for r in out if r.doc_id in (0, 1, 2)} == {1}
    assert lm_score.score(empty, counts, model).count() == 0
    nothing = lm_score.settled(lm_score.word_counts(empty), "test")
    assert {r.train_tokens for r in lm_score.score(odd, nothing, lm_score.train(empty)).collect()} == {0}


def counts_of(texts):
    out = Counter({lm_score.END: len(texts)})
    for ids in packing.part_ids(packing.default_tokenizer()).of([text.encode() for text in texts]):
        out.update(ids.tolist())
    return out


def shares_follow(model, counts):
    n = np.array([counts[i] for i in range(lm_score.VOCABULARY)]) + 0.1
    whole = np.bincount(model.classes, n, lm_score.CLASSES)[model.classes]
    return np.allclose(model.share, np.log(n / whole), atol=1e-4)


def test_lm_learns_from_all_documents(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "ist")]
    texts = [" ".join(rng.choice(names, rng.integers(1, 60))) for _ in range(1300)]
    docs = frame(spark, texts).repartition(5)
    monkeypatch.setattr(lm_score, "SHARD_WINDOWS", 150)  # several shards in a round
    model = lm_score.train(docs)
    assert shares_follow(model, counts_of(texts))
    again = lm_score.train(docs.repartition(3))
    assert all(np.array_equal(model.p[name], again.p[name]) for name in model.p)  # whatever the order of the rows
    held = packing.part_ids(packing.default_tokenizer()).of([" ".join(rng.choice(names, 40)).encode() for _ in range(20)])
    untrained = lm_score.Attention([], seen=lm_score.gathered(lm_score.settled(lm_score.pieces(docs), "test")))
    assert model.score(held).sum() > untrained.score(held).sum() + 100


def test_lm_learns_whole_texts_and_their_true_ends(spark, monkeypatch):
    texts = ["the cat sat on the mat " * 500 + "zebra crossing " * 40, "one two", ""]  # the long one's tail lies behind id 1,500
    assert shares_follow(lm_score.train(frame(spark, texts)), counts_of(texts))
    monkeypatch.setattr(lm_score, "PIECE", 2 * lm_score.BLOCK)
    for size in (0, 1, 31, 32, 63, 64, 65, 96, 127, 128, 500):
        own = np.arange(size)
        whole = lm_score.windows([own])
        parts = lm_score.windows(*zip(*lm_score.cut(own), strict=True))
        assert all(np.array_equal(a, b) for a, b in zip(whole[:2], parts[:2], strict=True))
        assert parts[1][parts[1] >= 0].tolist() == [*range(size), lm_score.END]  # the end once, behind the last id


def brute_counts(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(own) - 2):
        at.setdefault(tuple(own[i : i + 3]), []).append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_equal_brute_force(spark, odd, empty):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        texts = {r.doc_id: r.text for r in docs.collect()}
        got = quality_rules.judge(docs, docs.select("doc_id").limit(20)).collect()
        assert len(got) == docs.count()
        for r in got:
            want = brute_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.judge(empty, empty.select("doc_id")).count() == 0
    plain = quality_rules.judge(odd, empty.select("doc_id")).collect()
    assert all(r.kept == (not r.base_failed) for r in plain)


def test_quality_rules_learn_from_all_trusted_ids(spark, tmp_path, monkeypatch):
    texts = [f"w{i % 3} " * 60 for i in range(21_000)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.range(21_000).selectExpr("id doc_id", "1 quality")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    given = []
    monkeypatch.setattr(quality_rules, "judge", lambda docs, trusted: given.append(trusted.count()))
    quality_rules.op5_quality_rules(spark, str(tmp_path))
    assert given == [21_000]


def test_quality_rules_compute_cells_once(spark):
    docs = frame(spark, [None, "", "one", "one two", "b a b a"])
    counted = quality_rules.cell_counts(docs, docs.select("doc_id").filter("doc_id > 2"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(") == 2  # of words, and of pairs
    rows = counted.collect()
    assert (sum(r.raw for r in rows), sum(r.target for r in rows)) == (11, 10)


def test_quality_rules_plan_has_no_python(spark):
    plan = registered.op5_quality_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_quality_classifier_on_held_out_rows(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = registered.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95 and all(r.predicted == (r.score >= 0.5) for r in rows)
    model = quality_qda.fit(odd, spark.createDataFrame([(5, 1), (7, 1)], "doc_id bigint, quality int"))
    assert {r.quality.score for r in quality_qda.classify(odd, model).collect()} == {1.0}
    assert quality_qda.classify(empty, model).count() == 0


def test_url_rules(spark):
    urls = {
        "http://Www.Example.com/en/x?a#b": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://m.example.com/english": ("m.example.com", "/english", "com/", "allow"),
        "x://a.net/fr/1": ("a.net", "/fr/1", "net/fr/", "block"),
        "x://anet/fr/1": ("anet", "/fr/1", None, None),
        "x://a.com": ("a.com", "", None, None),
        "x://a.com?/": ("a.com", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "x://y://z.com/": ("y:", "//z.com/", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    rows = url_filter.judged(pages).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.rule_verdict) for r in rows] == list(urls.values())
    judged = url_filter.judge(pages, url_filter.fit(pages)).collect()
    assert all(r.verdict in ("allow", "block") for r in judged) and len(judged) == len(urls)


def test_url_models_learn_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = url_filter.fit(pages)
    rows = url_filter.judged(pages).filter("rule is not null").collect()
    right = [(model.ratio(r.url.encode()) > model.threshold) == (r.rule_verdict == "block") for r in rows]
    assert np.mean(right) > 0.9


def plain_chance(urls, url):
    """Nats of a url after the counts of others, by dictionaries."""
    after = {}
    for other in urls:
        for at, char in enumerate(other):
            for order in range(min(at, url_filter.ORDER) + 1):
                after.setdefault(other[at - order : at], Counter())[char] += 1
    nats = 0.0
    for at, char in enumerate(url):
        chance = 1 / 256
        for order in range(min(at, url_filter.ORDER) + 1):
            seen = after.get(url[at - order : at])
            if seen is None:
                break
            chance = (seen[char] + len(seen) * chance) / (sum(seen.values()) + len(seen))
        nats -= np.log(chance)
    return nats


def test_url_models_equal_counting_by_dictionaries(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model = url_filter.fit(pages, 24, 24)  # so many cells that few counts meet
    ruled = url_filter.judged(pages).filter("rule is not null").select("url", "rule_verdict").distinct().collect()
    trained = {kind: [r.url.encode() for r in ruled if r.rule_verdict == kind and zlib.crc32(r.url.encode()) % 5] for kind in ("allow", "block")}
    odd = [b"", b"x", "\u00e9://\U0001f600/".encode(), b"a" * 3000]
    for url in odd + [r.url.encode() for r in pages.limit(20).collect()]:
        want = (plain_chance(trained["allow"], url) - plain_chance(trained["block"], url)) / max(1, len(url))
        assert model.ratio(url) == pytest.approx(want, abs=0.01)


def test_every_ruled_url_is_counted(spark):
    """Far more urls than any sample had, each with a path of its own."""
    n = 30_000
    pages = spark.range(n).selectExpr("id AS page_id", "concat('http://a.', if(id % 2 = 0, 'com/', 'net/es/'), 'p', id) AS url")
    model = url_filter.fit(pages)
    kept = sum(zlib.crc32(f"http://a.com/p{i}".encode()) % 5 > 0 for i in range(0, n, 2))
    char = url_filter.cells(np.array([0]), url_filter.CONTEXT_BITS)[0]
    length = sum(len(f"http://a.com/p{i}") for i in range(0, n, 2) if zlib.crc32(f"http://a.com/p{i}".encode()) % 5)
    assert kept > 10_000 and model.totals[0][char] == length
    rows = url_filter.judge(pages.withColumn("url", F.concat(F.lit("http://b.org/"), F.expr("substr(url, 10)"))), model).collect()
    assert all((r.verdict == "block") == ("net/es" in r.path) for r in rows)


def test_url_models_of_nothing_and_of_one_kind(spark):
    none = spark.createDataFrame([], "page_id int, url string")
    assert url_filter.judge(none, url_filter.fit(none)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x"), (2, None), (2, None), (3, "q" * 200_000)], "page_id int, url string")
    assert [r.verdict for r in url_filter.judge(one, url_filter.fit(one)).collect()] == ["allow"] * 4


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    out = packing.pack_documents(odd.dropDuplicates(["doc_id"])).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    assert packing.pack_documents(empty).count() == 0 and packing.pack_documents(odd).filter("doc_id = 5").count() == 2


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 65, 3000).tolist(), reverse=True)
    room = []
    for (window, offset), length in zip(packing.best_fit(lengths, 64), lengths, strict=True):
        fits = [r for r in room if r >= length]
        if fits:
            assert 64 - offset == min(fits) == room[window]
        else:
            assert offset == 0 and window == len(room)
            room.append(64)
        room[window] -= length


def test_tokens_of_parts_equal_the_tokenizer():
    parts = packing.part_ids(packing.default_tokenizer())
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("'stmdrevl 19aÉéß.!\n\x1c日<|"), rng.integers(0, 30))) for _ in range(800)]
    texts += ["<|endoftext|> <|ENDOFTEXT|>", "I'LL 'tis !'s", "e\u0301 \u0301", "İstanbul ΣΑΣ"]
    for text, ids in zip(texts, parts.of([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == parts.tokenizer.encode(text, add_special_tokens=False).ids


def shingles(text):
    own = words(text)
    return frozenset(zip(own, own[1:], own[2:])) if len(own) > 2 else frozenset([tuple(own)] if own else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    of = {i: i for i in texts}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def edited_copies():
    """A passage that many texts share, groups of copies with some words changed, exact copies, short texts."""
    rng = np.random.default_rng(6)
    word = lambda: f"v{rng.integers(0, 4000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "one", "One", "one two", "one two", "a b c"]
    for _ in range(40):
        texts.append(" ".join([*passage, *(word() for _ in range(rng.integers(5, 80)))]))
    for size in (12, 90, 150):
        base = [word() for _ in range(size)]
        for _ in range(45):
            own = list(base)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(0, size)] = word()
            texts.append(" ".join(own))
    return dict(enumerate(texts, 100))


def test_join_finds_all_components(spark, empty):
    texts = edited_copies()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, n_shingles int")
    want = brute_components(texts)
    for bits in (20, 4):  # a coarse sketch orders badly and must find the same
        got = ngram_join.link_components(docs.union(docs.filter("doc_id = 104")), sketch_bits=bits).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want) + 1
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert ngram_join.link_components(empty).count() == 0


def brute_hits(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, text in items.items():
        own = split(text)
        size = min(13, len(own))
        for at in range(len(own) - size + 1) if own else ():
            windows.setdefault(tuple(own[at : at + size]), set()).add(str(item))
    out = {}
    for doc, text in texts.items():
        own, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(own) - size + 1):
                if held := windows.get(tuple(own[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= held
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own))
    return out


def test_contamination_equals_brute_force(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(8)
    few = [f"t{i}" for i in range(12)]
    items = {i: " ".join(rng.choice(few, n)) for i, n in enumerate([13, 14, 20, 5, 3, 40, 0])} | {99: None, 100: "ÉTÉ-a, b"}
    texts = {i: " ".join(rng.choice([*few, "zz"], 300)) + " " + (items[i % 6] or "") * (i % 3) for i in range(30)}
    texts |= {40: None, 41: "", 42: items[2].upper(), 43: items[5] + "; " + items[5], 44: "x " * 2000 + items[3], 45: "ÉTÉ A b"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, n_hit int")
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = brute_hits(texts, items)
    for block in (decontaminate.BLOCK_WORDS, 30):  # one block, and several passes
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = decontaminate.find_contamination(docs, benchmark)
        rows = found.select(
            "doc_id", "found.n_words", decontaminate.hit_words("found"), "found.items", decontaminate.is_contaminated("found")
        ).collect()
        got = {r[0]: (r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[4]) for r in rows}
        assert got == want
    kept = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert set(kept) == {i for i, w in want.items() if not w[4]} and kept[44].text.split() == ["x"] * 2000
    assert decontaminate.find_contamination(odd, empty.selectExpr("doc_id item_id", "text")).filter("size(found.first) > 0").isEmpty()
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(9)
    symbols = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (1, 5, 50, 200, 50)]).astype(np.int32)
    index = decontaminate.FMIndex(symbols, 3)
    text = symbols.tolist()
    for size in (1, 2, 3, 6):
        for _ in range(20):
            phrase = rng.integers(1, 4, size)
            low, high = index.search(phrase[None], np.array([size]))
            places = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
            assert places == [i for i in range(len(text) - size + 1) if text[i : i + size] == phrase.tolist()]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert 0.5 * before.count() < kept.count() <= before.count()
    components = {c for _, c in brute_components({r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "language_id")).collect()}).values()}
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "ngram_jaccard_join")).collect()} == components
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.agg(F.sum("length")).first()[0] == packed.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_on_an_empty_table(spark, empty):
    import corpus_pipeline

    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SMALL)
    assert out.count() == 0


def test_part_ids_take_little_memory():
    values = [f"Some words, one after another 1{i % 977} caf\u00c9 ".encode() * 200 for i in range(100)]
    tracemalloc.start()
    try:
        packing.split_parts(values)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * sum(map(len, values))
    ids = packing.PartIds(packing.default_tokenizer())
    want = [ids.tokenizer.encode(value.decode(), add_special_tokens=False).ids for value in values[:3]]
    assert [own.tolist() for own in ids.of(values[:3])] == want
    assert all(isinstance(own, bytes) for own in ids.kept.values())  # some 60 bytes a part, not an array
