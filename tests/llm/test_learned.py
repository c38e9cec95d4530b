"""Language ID, toxicity and personal data: held-out accuracy, and brute force where there is one."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corroborate.llm import langid, pii, toxicity

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 30):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 1 and set(np.unique(code)) <= {-1, 1}
    assert len(langid.codewords(4)[0]) == 7


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    m = langid.Model(list("abcd"), code, np.zeros((2, 7), np.float32), np.ones(7), 0.2)
    margins = 3 * code.copy()
    margins[:, 0] *= -1
    assert langid.decode(m, margins)[0].tolist() == [0, 1, 2, 3]
    assert langid.decode(m, np.zeros((1, 7)))[2].tolist() == [True]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.filter(langid.held_out(F.col("doc_id"))).select("doc_id", "lang", langid.predictor(spark, model)("text").alias("p")).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang == r.p.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.p.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, documents):
    texts = ["das ist ein deutscher satz und noch einer", "this is an english sentence and one more"]
    rows = [(k, texts[k % 2]) for k in range(40)]
    d = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    language = langid.predictor(spark, langid.fit(d))
    odd = documents([(1, None), (2, ""), (3, "123 !!"), (4, texts[0] * 5000), (4, texts[0] * 5000), (None, texts[1])])
    got = odd.select("doc_id", language("text")["lang_pred"].alias("p")).collect()
    assert [r.p for r in got] == ["und", "und", "und", "de", "de", "en"]
    assert langid.keep_known(spark, d).columns == d.columns
    none = langid.predictor(spark, langid.fit(documents([])))
    assert odd.select(none("text")["lang_pred"]).distinct().collect() == [("und",)]


def test_decoding_is_what_plain_loops_give():
    rng = np.random.default_rng(1)
    code, trust = langid.codewords(9), rng.uniform(0.1, 1, langid.codewords(9).shape[1])
    m = langid.Model(list("abcdefghi"), code, np.zeros((2, len(trust)), np.float32), trust, 2.0, 0.9)
    margins = rng.standard_normal((40, len(trust))) * 2
    best, score, vague = langid.decode(m, margins)
    for row, b, s, v in zip(margins, best, score, vague):
        loss = [sum(t * np.log1p(np.exp(-c * x)) for c, x, t in zip(word, row, trust)) for word in code]
        first, second = sorted(loss)[:2]
        assert b == np.argmin(loss) and abs(s - np.exp(-first) / sum(np.exp(-x) for x in loss)) < 1e-9
        assert v == (second - first < 2.0 or first > 0.9 * np.log(2) * trust.sum())


def test_letters_are_category_l(spark, documents):
    m = langid.train(["das ist ein satz", "this is one sentence"] * 5, ["de", "en"] * 5)
    assert [langid.predict(m, [t])[0][0] for t in ("½ ²", "Ⅷ ①", "٣ _ 7", "", None)] == ["und"] * 5
    assert langid.predict(m, ["½ ein satz das"])[0][0] == "de"


def test_no_language_is_left_out_of_the_sample(spark, documents):
    rows = [(k, f"text of language {k % 300} with {k} words") for k in range(900)]
    d = documents(rows).withColumn("lang", F.concat(F.lit("l"), F.pmod("doc_id", F.lit(300)).cast("string")))
    drawn = langid.labelled_sample(d, langid.Params(max_rows=100))
    assert 290 < len({r.lang for r in drawn}) == len(drawn)  # a language all of whose rows are held out has none to learn from
    assert drawn == langid.labelled_sample(d.repartition(7), langid.Params(max_rows=100))


def test_repeated_ids_give_the_same_sample_in_any_order(spark, documents):
    d = documents([(k % 3, f"text {k}") for k in range(600)])
    drawn = langid.labelled_sample(d, langid.Params(max_rows=50))
    assert drawn == langid.labelled_sample(d.repartition(5), langid.Params(max_rows=50)) and len(drawn) <= 50
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(3)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(d, labels, toxicity.Params(max_rows=20))
    assert got == toxicity.labelled_sample(d.repartition(5), labels, toxicity.Params(max_rows=20)) and len(got) <= 80


def test_the_language_stage_rejects_by_the_decoding(spark, documents):
    de, en = "das ist ein deutscher satz und noch einer dazu", "this is an english sentence and one more of these"
    told = documents([(k, (de, en)[k % 2]) for k in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    mixes = [" ".join(de.split()[:i] + en.split()[:j]) for i in range(9) for j in range(9)]
    vague = next(t for t, x in zip(mixes, langid.predict(langid.fit(told), mixes)) if x[2])
    odd = documents([(-1, de), (-2, en), (-3, "12 34 !!"), (-4, None), (-5, ""), (-6, vague), (None, en), (-1, de)]).withColumn("lang", F.lit(None).cast("string"))
    both = told.unionByName(odd)
    ids = lambda d: sorted((r.doc_id for r in d.filter("doc_id is null or doc_id < 0").select("doc_id").collect()), key=str)
    kept = langid.keep_known(spark, both)
    assert ids(kept) == [-1, -1, -2, None] and kept.columns == both.columns
    assert ids(langid.keep_known(spark, both, languages=("en",))) == [-2, None]
    assert ids(langid.keep_known(spark, odd)) == [-1, -1, -2, -6, None]  # nothing is learned, so only texts without a letter go
    assert langid.keep_known(spark, both.limit(0)).count() == 0


def test_the_language_stage_leaves_documents_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.keep_known(spark, docs).count() >= 0.999 * docs.count()


def test_noisy_or_and_offending_places():
    m = toxicity.Model(-8.0, {b"idiot": 12.0, b"clown": 10.0}, 0.5)
    text = "Ünd all is well. You IDIOT, go away! Fine\nclown"
    score, n, bad = toxicity.score(m, text)
    p = [1 / (1 + np.exp(8)), 1 / (1 + np.exp(-4)), 1 / (1 + np.exp(8)), 1 / (1 + np.exp(-2))]
    assert abs(score - (1 - np.prod([1 - x for x in p]))) < 1e-9 and n == 4
    assert [text[a:b].strip() for a, b, _ in bad] == ["You IDIOT, go away", "clown"]
    assert toxicity.score(m, None) == toxicity.score(m, "") == (0.0, 0, [])
    assert toxicity.score(m, "... !!")[0] == 0.0


def test_gradient_of_the_noisy_or():
    rng = np.random.default_rng(3)
    index = {str(k).encode(): k for k in range(6)}
    bags = [[[str(x).encode() for x in rng.integers(0, 9, rng.integers(1, 4))] for _ in range(rng.integers(1, 5))] for _ in range(12)]
    bag = toxicity.Bags.of(bags, index, np.array([1.0, 0] * 6))
    w, bias = rng.standard_normal(6), -1.5
    loss, gw, gb = bag.loss(w, bias)
    plain = 0.0
    for b, y in zip(bags, bag.y):
        none = np.prod([1 / (1 + np.exp(bias + sum(w[k] for k in {index[x] for x in s if x in index}))) for s in b])
        plain -= (np.log(1 - none) if y else np.log(none)) / 12
    assert abs(loss - plain) < 1e-9
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert abs((bag.loss(w + step, bias)[0] - bag.loss(w - step, bias)[0]) / 2e-6 - gw[k]) < 1e-6
    assert abs((bag.loss(w, bias + 1e-6)[0] - bag.loss(w, bias - 1e-6)[0]) / 2e-6 - gb) < 1e-6


def test_toxicity_of_odd_tables(spark, documents):
    rows = [(k, "you idiot go away now" if k % 2 else "all is well here today") for k in range(400)]
    labels = spark.createDataFrame([(k, 0, k % 2, "clash") for k in range(400)], "doc_id long, quality int, toxic int, t string")
    score = toxicity.scorer(spark, toxicity.fit(documents(rows), labels))
    odd = documents([(1, None), (2, ""), (3, "fine words. " * 30_000 + "You IDIOT, go away! fine"), (3, "all is well"), (3, "all is well"), (None, "you idiot go away")])
    got = [r.t for r in odd.select(score("text").alias("t")).collect()]
    assert [x.score >= 0.5 for x in got] == [False, False, True, False, False, True] and [len(x.offending) for x in got] == [0, 0, 1, 0, 0, 1]
    assert documents([]).select(score("text")).count() == 0 and toxicity.fit(documents([]), labels).weights == {}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    score = toxicity.scorer(spark, toxicity.fit(docs, labels))
    rows = docs.join(labels, "doc_id").filter(langid.held_out(F.col("doc_id"))).select("toxic", score("text")["score"].alias("s")).collect()
    pos, neg = [r.s for r in rows if r.toxic], [r.s for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.93 and np.mean([b >= 0.5 for b in neg]) < 0.03 and np.mean([a >= 0.5 for a in pos]) > 0.75


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents([(1, "x")]), none).weights == {}
    only = spark.createDataFrame([(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    score = toxicity.scorer(spark, toxicity.fit(documents([(1, "x")]), only))
    assert documents([(1, "x"), (2, None)]).select(F.max(score("text")["score"])).first()[0] < 1e-6


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_patterns_match_plain_regular_expressions():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1234.@+-() %_é") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["a@b", "x.y@c.d-e.f@g.h", "1.2.3.4.5", "256.1.1.1 1.1.1.01", "4271745256831383 4271-7452-5683-1383", "+1 (227) 555-1234", "..@a.b..c", "٤.1.1.1"]
    assert [t for t in texts if pii.patterns(t) != brute(t)] == []


def test_patterns_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1((" * 50_000, "1." * 100_000):
        pii.patterns(t)


def test_the_network_adds_spans_and_keeps_the_patterns():
    model = pii.train()
    rng = np.random.default_rng(99)
    made = [pii._sentence(rng) for _ in range(300)]
    found = pii.find(model, [t for t, _ in made])
    want = {(k, s) for k, (_, spans) in enumerate(made) for s in spans}
    got = {(k, s) for k, (_, spans) in enumerate(found) for s in spans}
    base = {(k, s) for k, (b, _) in enumerate(found) for s in b}
    assert base <= got and len(want & got) / len(want) > 0.85 and len(got - base - want) / len(got) < 0.05
    for _, spans in found:
        ends = sorted((a, b) for _, a, b in spans)
        assert len(ends) == len(set(ends))
    for b, spans in found:
        extra = [s for s in spans if s not in b]
        assert all(s[2] <= x or y <= s[1] for s in extra for other in spans if other != s for x, y in [other[1:]])


def test_gradient_of_the_crf():
    rng = np.random.default_rng(0)
    e, y = rng.standard_normal((5, 2, 3)), rng.integers(0, 3, (5, 2))
    moves, start = rng.standard_normal((3, 3)), rng.standard_normal(3)

    def loss(e, moves):
        from itertools import product

        total = 0.0
        for b in range(2):
            path = lambda s: start[s[0]] + sum(e[t, b, s[t]] for t in range(5)) + sum(moves[s[t - 1], s[t]] for t in range(1, 5))  # noqa: B023, E731
            total += np.log(sum(np.exp(path(s)) for s in product(range(3), repeat=5))) - path(y[:, b])
        return total

    d_e, d_moves, _ = pii._crf_grad(e, y, moves, start)
    for i in ((0, 0, 1), (4, 1, 2), (2, 0, 0)):
        step = np.zeros_like(e)
        step[i] = 1e-5
        assert abs((loss(e + step, moves) - loss(e - step, moves)) / 2e-5 - d_e[i]) < 1e-5
    step = np.zeros_like(moves)
    step[1, 2] = 1e-5
    assert abs((loss(e, moves + step) - loss(e, moves - step)) / 2e-5 - d_moves[1, 2]) < 1e-5


def test_gradient_of_the_lstm():
    rng = np.random.default_rng(1)
    k, x = 3, rng.integers(0, 5, (6, 2))
    table, u, aim = rng.standard_normal((5, 4 * k)), rng.standard_normal((k, 4 * k)), rng.standard_normal((6, 2, k))

    def states(table, u):
        """The recurrence step by step, a cell at a time, in double precision."""
        out = np.zeros((6, 2, k))
        for b in range(2):
            h, c = np.zeros(k), np.zeros(k)
            for t in range(6):
                g = table[x[t, b]] + h @ u
                i, f, o = (1 / (1 + np.exp(-g[j * k : (j + 1) * k])) for j in range(3))
                c = f * c + i * np.tanh(g[3 * k :])
                h = o * np.tanh(c)
                out[t, b] = h
        return out

    got, tape = pii._lstm(x, table.astype(np.float32), u.astype(np.float32), True)
    assert np.abs(got - states(table, u)).max() < 1e-5
    d_table, d_u = pii._lstm_back(x, aim.astype(np.float32), tape, table.astype(np.float32), u.astype(np.float32))
    for what, d in ((table, d_table), (u, d_u)):
        for i in ((0, 0), (1, 4), (2, 7), (1, 11)):
            step = np.zeros_like(what)
            step[i] = 1e-6
            pair = [((states(table + s, u) if what is table else states(table, u + s)) * aim).sum() for s in (step, -step)]
            assert abs((pair[0] - pair[1]) / 2e-6 - d[i]) < 1e-3


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    f = lambda *s: rng.standard_normal(s).astype(np.float32)
    for _ in range(5):
        m = pii.Model([f(4, 8), f(4, 8)], [f(2, 8), f(2, 8)], f(5, 3) * 2, f(3, 3), f(3))
        x = rng.integers(0, 4, (6, 3))
        e = np.concatenate([pii._lstm(x, m.inputs[0], m.hidden[0])[0], pii._lstm(x[::-1], m.inputs[1], m.hidden[1])[0][::-1], np.ones((6, 3, 1), np.float32)], 2) @ m.out
        for b, tags in enumerate(pii.viterbi(m, x)):
            score = lambda p: m.start[p[0]] + sum(e[t, b, p[t]] for t in range(6)) + sum(m.moves[p[t - 1], p[t]] for t in range(1, 6))  # noqa: B023, E731
            best = max(product(range(3), repeat=6), key=score)
            assert abs(score(best) - score(tags.tolist())) < 1e-4


def test_many_windows_find_what_one_window_finds(monkeypatch):
    model, rng = pii.train(), np.random.default_rng(123)
    texts = [" ".join(pii._sentence(rng)[0] for _ in range(6)) for _ in range(60)]
    assert min(map(len, texts)) > 2 * pii.WINDOW
    many = pii.find(model, texts)
    monkeypatch.setattr(pii, "WINDOW", 1 << 14)
    one = pii.find(model, texts)
    a, b = ({(d, s) for d, (base, spans) in enumerate(x) for s in spans if s not in base} for x in (many, one))
    assert len(b) > 200 and len(a ^ b) <= 0.02 * len(b)


def test_long_spans_are_whole():
    model = pii.train()
    for name in ("janemargaretdoe.smithson", "j" * 20 + ".smithson" * 4, "jane_" * 12 + "doe"):
        for before in ("", "plain words before it and more of them, " * 3, "here are some plain words before the address is "):
            span = f"{name} [at] postoffice.example.com"
            found = pii.find(model, [f"{before}{span} and after"])[0][1]
            assert ("email", len(before), len(before) + len(span)) in found, (name, before)
    assert pii.find(model, ["12345 " * 40_000 + "@ [at] " * 300])[0][0] == []


def test_personal_data_columns_that_clash(spark):
    d = spark.createDataFrame([(1, "a@b.org", "x", 5)], "doc_id long, text string, spans string, n_email int")
    assert d.select(pii.finder(spark)("text")["n_email"].alias("n")).first().n == 1


def test_personal_data_columns(spark, documents):
    t = "write to a.b@mail.example.com or (416) 555-9937 now"
    rows = documents([(1, t), (1, t), (2, None), (3, ""), (None, "x" * 100_000 + " 10.0.0.1")]).select("doc_id", pii.finder(spark)("text").alias("p")).collect()
    assert rows[0].p == rows[1].p and rows[0].p.n_email == 1 and rows[0].p.spans.startswith("email:9:29")
    assert rows[2].p.spans == "" and rows[3].p.spans == "" and rows[4].p.n_ip == 1
    assert documents([]).select(pii.finder(spark)("text")).count() == 0
