"""Corpus operators against brute force, with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import chat, components, decontamination, exact_dedup, licenses, mixing, ngram_join, sharding, substring_dedup, textvec, toxicity, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long"


def docs_of(spark, rows, parts=3):
    """rows: (doc_id, text, source); two columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows], DOCS).repartition(parts)


def low(t):
    return (t or "").translate(LOWER)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "one two"), (6, "a b c")]
    for i in range(7, n):
        if rnd.random() < 0.5 and i > 12:
            words = (rows[rnd.randrange(7, i)][1] or "x").split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120)))))
    rows.append((n, " ".join(rnd.choice(vocabulary) for _ in range(30_000))))
    return [(i, t, rnd.choice(["hot", "hot", "b", "c", None])) for i, t in rows]


# ---- 1 chat


def test_chat_round_trip_and_spans():
    rnd = random.Random(1)
    for _ in range(400):
        turns = [(rnd.choice(["user", "assistant", ""]), "".join(rnd.choice(["<", "|", ">", "[INST]", "</s>", "\\", "\n", "x", "\x02\x03"[:1]]) for _ in range(rnd.randint(0, 9)))) for _ in range(rnd.randint(1, 40))]
        whole, spans, rewrites = chat.spans(turns, anchor=rnd.choice([1, 3, 16]))
        assert not rewrites and chat.parse(whole) == turns
        assert [chat.unescape(whole[a:b]) for a, b in spans] == [t for _, t in turns]
        for _, t in turns:
            assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat_detects_rewritten_history():
    hides = lambda ts: "".join(f"[{r}]{'...' if i < len(ts) - 1 else t}" for i, (r, t) in enumerate(ts))
    whole, spans, rewrites = chat.spans([("user", "abc"), ("assistant", "hello")], hides)
    assert rewrites and spans[0] == (-1, -1) and whole[slice(*spans[1])] == "hello"
    begins = lambda ts: "<s>" + "".join(f"[{r}]{t}\n" for r, t in ts)
    turns = [("u", str(i)) for i in range(70)]
    whole, spans, rewrites = chat.spans(turns, begins)
    assert not rewrites and [whole[a:b] for a, b in spans] == [t for _, t in turns]


def test_chat_query_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, 0, None, "</s>"), (None, 0, "assistant", "é😀")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\nassistant\nb\n") and got[1]["loss_sha256"] == sha("bb") and got[1]["n_turns"] == 3
    assert got[2]["turns_sha256"] == sha("\n</s>\n") and got[2]["loss_chars"] == 0
    assert got[None]["loss_chars"] == 2
    lone = spark.createDataFrame([(None, 0, "assistant", "a"), (None, 0, "assistant", "b"), (3, None, "assistant", "x" * 200_000)], "conv_id long, turn long, role string, text string")
    assert sorted(r["loss_chars"] for r in chat.digests(chat.format_conversations(lone)).collect()) == [1, 1, 200_000]
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- 2 toxicity


def test_toxic_grammar():
    g = toxicity.Grammar({"idiot": 4.0})
    score = lambda t: sum(s for _, _, s in g.clauses(t))
    assert score("what an idiot") > 0 > score("he is not an idiot"[3:])
    assert score("you idiot") > score("an idiot") > score("she said idiot")
    assert score("i will kill you") > 0 and score("skill kills time") == 0 and g.clauses("clean words.") == []
    assert score("preidiot") == 0 and g.features(None) == g.features("") == [0.0] * toxicity.FEATURES


def toxic_tables(spark, n=400):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(2):
                t.insert(rnd.randrange(60), rnd.choice(["zquarx", "zquarxen", "idiot"]))
        docs.append((i, " ".join(t), "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(n, None, "s"), (n + 1, "", "s"), (None, "plain", "s")]
    return docs_of(spark, docs), spark.createDataFrame([*labels, (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_the_rest_and_finds_the_held_out(spark):
    docs, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in held) / len(held) >= 0.95
    assert got[400]["score"] == got[401]["score"] < 0.5 and got[None]["predicted"] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r["predicted"]}


def slow_features(stems, text):
    """The features by looking back over the words of each clause, without machines."""
    scores = []
    for clause in re.split(r"[.!?;\n]", text):
        starts = [m.start() for m in re.finditer(r"[^\W\d_]", clause) if not m.start() or not clause[m.start() - 1].isalpha()]
        threats = [at for at in starts for t in toxicity.THREATS if re.match(re.escape(t) + r"(?![^\W\d_])", clause[at:])]
        if not threats and not any(clause.startswith(s, at) for at in starts for s in stems):
            continue
        words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)
        weight = [max((w for s, w in stems.items() if x.startswith(s)), default=None) for x in words]
        role = lambda i, names: weight[i] is None and words[i] in names
        is_threat = [weight[i] is None and x in toxicity.THREATS for i, x in enumerate(words)]
        kind = lambda i, names: role(i, names) and not is_threat[i]
        targets = [kind(i, toxicity.TARGETS) and not role(i, toxicity.MODALS) for i in range(len(words))]
        reports = [j for j in range(len(words)) if kind(j, toxicity.REPORTING)]
        score, menace = 0.0, 0
        for i, x in enumerate(words):
            denied = any(kind(j, toxicity.NEGATIONS) for j in range(max(0, i - 3), i))
            quoted = any(j < i for j in reports[:1])
            aimed = any(targets[max(0, i - 5) : i])
            if weight[i] is not None:
                score += weight[i] * (-0.5 if denied else 0.4 if quoted else 1.5 if aimed else 1.0)
            elif is_threat[i] and not denied:
                score += 4.0 * 0.4 if quoted else 0
                menace = 2 if menace == 1 and not quoted else menace
            elif role(i, toxicity.MODALS):
                menace = max(menace, 1)
            elif targets[i] and menace == 2:
                score, menace = score + 2.0 * 4.0, 0
        scores.append(score)
    up = [s for s in scores if s > 0]
    return [float(bool(up)), min(sum(up), 40) / 10, max(up, default=0) / 10, np.log1p(len(up)), np.log1p(sum(up) / (1 + len(text) / 500)), float(len(scores) > len(up)), np.log1p(-sum(s for s in scores if s < 0))]


def test_grammar_against_looking_back():
    rnd = random.Random(5)
    stems = {"idiot": 4.0, "scu": 3.5, "zquarx": 5.0, "kil": 3.0}
    some = [["idiot", "idiots", "scum", "zquarx", "l'idiot", "1idiot"], sorted(toxicity.THREATS), sorted(toxicity.MODALS), sorted(toxicity.TARGETS), sorted(toxicity.NEGATIONS), sorted(toxicity.REPORTING), ["word", "xx", "é"]]
    g = toxicity.Grammar(stems)
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(some)) + rnd.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rnd.randint(0, 14)))
        assert np.allclose(slow_features(stems, text), g.features(text), atol=1e-9), text


def test_toxicity_against_brute_force_and_any_dealing(spark):
    """The query's scores, row by row, from the fitted grammar; the model doesn't depend on how rows are stored."""
    docs, labels = toxic_tables(spark)
    docs = docs.union(docs.limit(30)).union(docs_of(spark, [(9001, "x " * 20_000 + "you zquarx", "s"), (9002, "I will hurt you", "s")]))
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels.repartition(5))
    assert again.stems == model.stems and again.weights == model.weights
    grammar = toxicity.Grammar(model.stems)
    w = np.array(model.weights)
    got = toxicity.toxicity(docs, labels).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        x = slow_features(model.stems, (text[r["doc_id"]] or "").lower())
        assert np.allclose(x, grammar.features(text[r["doc_id"]]), atol=1e-9)
        assert abs(r["score"] - 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))) < 1e-12 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 20)
    assert toxicity.toxicity(docs, labels.where("false")).count() == 23
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


# ---- 3 mixing


def test_mixing_keeps_lag_below_a_block(spark):
    rows = [(i, "t", "a" if i % 3 else "b") for i in range(900)] + [(900 + i, "t", None) for i in range(100)]
    weights = {"a": 0.5, "b": 0.3, "": 0.2}
    got = mixing.mix(docs_of(spark, rows), weights, block=5, cycle=100).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000)) and len({r["doc_id"] for r in got}) == 1000
    blocks = {}
    for r in got:
        blocks.setdefault(r["slot"], r["source"] or "")
    done, left = {k: 0 for k in weights}, {"a": 120, "b": 60, "": 20}
    for slot in range(max(blocks) + 1):
        if any(done[k] >= left[k] for k in weights):
            break
        assert slot in blocks
        done[blocks[slot]] += 1
        assert all(abs(done[k] - w * (slot + 1)) < 1 for k, w in weights.items()), (slot, done)


@pytest.mark.parametrize("sizes", [[9000, 1000], [6000] + [300] * 19, [3000] + [17] * 30 + [400] * 9])
def test_mixing_follows_exact_weights_over_many_cycles(spark, sizes):
    rows, shares = [], {}
    for j, n in enumerate(sizes):
        rows += [(len(rows) + i, "t", f"s{j:02}") for i in range(n)]
        shares[f"s{j:02}"] = n**0.7
    total = sum(shares.values())
    for weights, share in ((None, {k: v / total for k, v in shares.items()}), ({"s00": 0.5}, {k: 0.5 if k == "s00" else 0.5 * v / (total - shares["s00"]) for k, v in shares.items()})):
        got = mixing.mix(docs_of(spark, rows), weights, block=1, cycle=100).orderBy("position").collect()
        assert [r["position"] for r in got] == list(range(len(rows))) and len({r["doc_id"] for r in got}) == len(rows)
        assert all(a["slot"] <= b["slot"] for a, b in zip(got, got[1:]))
        done, left = dict.fromkeys(share, 0), {f"s{j:02}": n for j, n in enumerate(sizes)}
        for t, r in enumerate(got):
            assert r["slot"] == t
            done[r["source"]] += 1
            assert all(abs(done[k] - w * (t + 1)) < 1 + 1e-4 for k, w in share.items()), (t, done)
            if any(done[k] == left[k] for k in done):
                break
        assert t > 250


def test_mixing_of_a_source_without_weight(spark):
    rows = [(i, "t", "a" if i < 300 else "b") for i in range(400)]
    got = mixing.mix(docs_of(spark, rows), {"a": 1.0}, block=4, cycle=100).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(400)) and {r["source"] for r in got[:300]} == {"a"}


def test_mixing_of_null_ids_long_texts_and_clashing_columns(spark):
    rows = [(None, f"t{i}", "a") for i in range(50)] + [(7, "same", "b")] * 20 + [(8, "x " * 60_000, None)]
    docs = docs_of(spark, rows)
    for c in ("_position", "position", "_key", "slot", "src", "block"):
        docs = docs.withColumn(c, F.lit(c))
    got = mixing.mix(docs, block=4, cycle=50)
    assert sorted(r["position"] for r in got.collect()) == list(range(71))
    out = mixing.mixed_documents(docs, block=4, cycle=50)
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == sorted(t for _, t, _ in rows)
    order = [r["source"] for r in out.collect()]
    assert {"a", "b"} <= set(order[:30])  # null ids are dealt out like others


def test_mixing_edges(spark):
    assert mixing.mix(docs_of(spark, [(1, "x", "a")]).where("false")).count() == 0
    same = docs_of(spark, [(1, "x", "a")] * 4 + [(None, "y", None)])
    assert sorted(r["position"] for r in mixing.mix(same).collect()) == list(range(5))
    out = mixing.mixed_documents(docs_of(spark, [(i, "x", "ab"[i % 2]) for i in range(20)]))
    assert out.count() == 20 and out.columns == docs_of(spark, []).columns


# ---- 4 url filter


def test_url_rules_and_parsing(spark):
    urls = ["http://a.Example.COM/en/7x?q", "https://com/en/", "http://x.net/de/1", "http://example.net/de/88#f", "http://a.org/es/", "http://notexample.com.org?x", None, "no scheme", "://h/p", "http://é/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = pages.withColumn("suffix", F.lit(1)).withColumn("fit", F.lit(2)).union(spark.createDataFrame([(0, urls[0], 1, 2)], "page_id long, url string, suffix int, fit int"))
    model = url_filter.train(url_filter.rule_labels(pages).select("url", "label"))
    assert url_filter.judge(pages, model).count() == 11 and url_filter.judge(pages.where("false"), model).count() == 0
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    want = {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("org/es/", "block")}
    assert {i: (got[i]["rule"], got[i]["verdict"]) for i in want} == want
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/7x") and got[5]["rule"] is None
    assert all((got[i]["host"], got[i]["path"]) == ("", "") for i in (6, 7)) and got[8]["host"] == "h" and got[9]["path"] == "/ü"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_url_tree_equals_brute_force(spark):
    """Split for split: gains from sums over all rows for every (node, feature, bin)."""
    rnd = np.random.default_rng(4)
    n, features = 120, 4
    b = rnd.integers(0, 6, (n, features))
    y = ((b[:, 1] > 2) ^ (rnd.random(n) < 0.15)).astype(float)
    margin = 0.3
    p = 1 / (1 + np.exp(-margin))
    g, h = y - p, np.full(n, p * (1 - p))

    def grow(rows, depth):
        value = 0.4 * g[rows].sum() / (h[rows].sum() + url_filter.RIDGE)
        best = (1e-6, None)
        if depth:
            for f in range(features):
                for cut in sorted(set(b[rows, f].tolist()))[:-1]:
                    at = rows & (b[:, f] <= cut)
                    no = rows & ~at
                    won = sum(g[m].sum() ** 2 / (h[m].sum() + url_filter.RIDGE) for m in (at, no)) - g[rows].sum() ** 2 / (h[rows].sum() + url_filter.RIDGE)
                    if won > best[0] + 1e-9:
                        best = (won, (f, cut))
        if best[1] is None:
            return value
        f, cut = best[1]
        return f, cut, grow(rows & (b[:, f] <= cut), depth - 1), grow(rows & (b[:, f] > cut), depth - 1)

    x = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(b, y)], "b array<int>, y double")
    sql = url_filter._tree(x, f"{margin}D", 3, 0.4)

    def parsed(text):
        m = re.fullmatch(r"if\(b\[(\d+)\] <= (\d+), (.*)\)", text)
        if not m:
            return float(text.rstrip("D"))
        inner, level = m[3], 0
        for i, c in enumerate(inner):
            level += (c == "(") - (c == ")")
            if c == "," and not level:
                return int(m[1]), int(m[2]), parsed(inner[:i]), parsed(inner[i + 2 :])

    def same(a, c):
        return abs(a - c) < 1e-9 if isinstance(a, float) or isinstance(c, float) else a[:2] == c[:2] and same(a[2], c[2]) and same(a[3], c[3])

    want = grow(np.ones(n, bool), 3)
    assert isinstance(want, tuple) and same(parsed(sql), want)


def test_url_trees_learn(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        bad = rnd.random() < 0.4
        host = ("cheap-pills-" + str(rnd.randrange(10**6)) if bad else rnd.choice(["blog", "www", "m"])) + ".site.org"
        rows.append((f"http://{host}/{rnd.randrange(99)}" + ("?a=1&b=2&c=3" if bad and rnd.random() < 0.5 else ""), int(bad)))
    all_rows = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.train(all_rows.limit(400), trees=5)
    host, path = url_filter.host_and_path(F.col("url"))
    got = model.score(all_rows.select("url", "label", host.alias("host"), path.alias("path"))).collect()
    assert sum((r["score"] >= 0.5) == bool(r["label"]) for r in got) / len(got) > 0.97
    assert url_filter.train(all_rows.where("false")).prior == 0.0


# ---- 5 licenses


def slow_licenses(words):
    """labels and score: every alignment of every template, its hits walked in order."""
    labels, best = set(), 0.0
    for is_base, (phrase, label) in [(True, x) for x in licenses.BASE] + [(False, x) for x in licenses.TEMPLATES]:
        p = phrase.split()
        k = 4 if len(p) >= 12 and not is_base else 2
        hits = [(j, i) for j in range(len(p) - k + 1) for i in range(len(words) - k + 1) if words[i : i + k] == p[j : j + k]]
        for low_end in {i - j for j, i in hits}:
            t = pos = -1
            n = 0
            for j, i in sorted(hits):
                if low_end <= i - j <= low_end + (0 if is_base else 3) and j > t and i > pos:
                    t, pos, n = j, i, n + 1
            share = n / (len(p) - k + 1)
            if share >= (1.0 if is_base else 0.9):
                labels.add(label)
                best = 1.0
            best = max(best, min(share, 0.99))
    return ",".join(sorted(labels)), best


def test_licenses_against_brute_force(spark):
    texts = [None, "", "mit license", "MIT License, MIT-license", "the KK mitK license", "mit lıcense mİt license", "Apache License.", "GNU General Public License, version 3", "Licensed under the Apache License, Version 2.0.", "general public", "license mit license", "x " * 30_000 + "mit license", "all rights reserved é", "Released under MIT License", "All rights reserved. " * 4, " -- "]
    rnd = random.Random(3)
    for phrase, _ in licenses.TEMPLATES:
        for _ in range(4):
            w = phrase.split() * rnd.choice([1, 1, 2])
            for _ in range(rnd.choice([0, 1, 2, 4])):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[], ["zz"], [w[at], "zz"], ["zz", "zz", w[at]]])
            if rnd.random() < 0.2:
                rnd.shuffle(w)
            texts.append(" ".join(["aa", *w, "bb"]))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(2, "mit license", "s"), (None, "mit license", "s")]
    got = licenses.license_labels(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        starts, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = by[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(starts), ",".join(sorted(labels))), t
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None)), t
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["labels"], r["score"]) == slow_licenses(words), t
    assert "apache-2.0" in by[8]["labels"] and by[12]["labels"] == "all-rights-reserved"
    assert licenses.license_labels(docs_of(spark, rows).where("false")).count() == 0


# ---- 6 decontamination


def test_containment_against_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(6, 40)))) for i in range(30)] + [(30, None), (31, "..."), (32, "two words")]
    rows = []
    for i in range(60):
        t = [rnd.choice(words) for _ in range(rnd.randint(0, 3000 if i == 5 else 200))]
        if i % 3 == 0:
            item = items[rnd.randrange(30)][1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                item[rnd.randrange(len(item))] = "zz"
            at = rnd.randrange(len(t) + 1)
            t[at:at] = [w.upper() for w in item]
        rows.append((i, ", ".join(t), "s"))
    rows += [(70, None, "s"), (71, "Two words!", "s"), (0, rows[0][1], "s"), (72, "in a longer text stand Two words of an item", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def runs(t, k):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = sorted((d, i) for d, t, _ in rows for i, x in items if (g := grams(x)) and len(g & runs(t, len(next(iter(g))))) >= 0.8 * len(g) - 1e-9)
    docs = docs_of(spark, rows)
    for size in (2_000_000, 100):
        assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contained_items(docs, bench, slice_size=size).collect()) == want
    short = {(d, 32) for d, t, _ in rows if re.search(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])two words(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])", low(t))}
    assert (71, 32) in want and (72, 32) in want and short == {x for x in want if x[1] == 32} and len(want) > 10
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(d for d, _, _ in rows if d not in {x for x, _ in want})
    assert decontamination.contained_items(docs, bench.where("false")).count() == 0 == decontamination.contained_items(docs.where("false"), bench).count()


# ---- 7 sharding


def test_decontamination_judges_rows_by_themselves(spark):
    """Null and shared doc_ids, clashing columns, repeated rows and items: only rows that hold an item go."""
    item = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, item), (1, item), (None, "nine"), (2, None)], "item_id long, text string")
    rows = [(None, "clean text of a null row", "s"), (None, f"x {item} y", "s"), (None, "clean text of a null row", "s"), (5, "clean", "s"), (5, f"z {item}", "s"), (6, "up to Nine.", "s"), (7, None, "s"), (8, "x " * 50_000 + item, "s")]
    docs = docs_of(spark, rows).withColumn("item_id", F.lit(3)).withColumn("_bad_id", F.lit(4))
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "clean text of a null row")] * 2 + [(5, "clean"), (7, "")]
    found = decontamination.contained_items(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in found) == [(0, 1), (0, 1), (5, 1), (5, 1), (6, 0), (8, 1), (8, 1)]


def heap_loads(sizes, shards):
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


def test_lpt_equals_single_steps():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = [rnd.choice([1, 1, 1, 2, 7, 50, rnd.randint(1, 500)]) for _ in range(rnd.randint(0, 300))]
        k = rnd.randint(1, 9)
        loads = [0] * k
        for size, own, ends in sharding.lpt([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], k):
            for s, n in zip(own, np.diff([0, *ends])):
                loads[s] += size * int(n)
        assert sorted(loads) == heap_loads(sizes, k)


@pytest.mark.parametrize("at_once", [3, 50_000])
def test_sharding(spark, monkeypatch, at_once):
    monkeypatch.setattr(sharding, "SIZES", at_once)
    rows = corpus(1) + [(100 + i, "copy of one", "s") for i in range(40)] + [(5, "one two", "b"), (None, "nul", None)]
    got = sharding.shard_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, where = {}, {}
    for i, t, _ in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 1
    loads = {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        assert where.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sorted(loads.get(s, 0) for s in range(8)) == heap_loads(list(sizes.values()), 8)
    for s in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_documents(docs_of(spark, rows).where("false")).count() == 0


# ---- 8 n-gram join


def brute_components(rows, k, percent, pattern=r"[^\x20\x09-\x0D]+"):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(pattern, low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_join_against_brute_force(spark, k, percent):
    rows = corpus(k)
    docs = docs_of(spark, rows + rows[10:14])
    got = ngram_join.linked_components(docs, k, percent).collect()
    want = brute_components(rows, k, percent)
    assert len(got) == len(rows) + 4
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 3


@pytest.mark.parametrize("branch", [400, 2500, 1 << 20])
def test_join_of_many_near_copies_uses_trees(spark, monkeypatch, branch):
    rnd = random.Random(8)
    words = [f"u{i}" for i in range(5000)]
    rows, base = [], [rnd.choice(words) for _ in range(60)]
    for i in range(140):
        t = list(base)
        for _ in range(rnd.choice([1, 2, 3, 3, 4])):
            t[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(t), "s"))
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "BRANCH", branch)
    got = ngram_join.linked_components(docs_of(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 85)


def test_dual_traversal_loses_nothing():
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(90)]
    for i in range(60):
        sets.append(np.unique(np.concatenate([sets[i % 20][: 40 - i % 5], rnd.integers(0, 2**63, i % 6).astype(np.uint64)])))
    n = np.array([len(s) for s in sets])
    bitmaps, label = [ngram_join._bitmap(s) for s in sets], np.arange(len(sets))
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    for found in (ngram_join.block_pairs(bitmaps, n, label, np.zeros(len(sets), int), 80), ngram_join.leaf_pairs(bitmaps, n, label, [(0, len(sets))], 80)):
        got = {(min(a, b), max(a, b)) for x, y in found for a, b in zip(x.tolist(), y.tolist())}
        assert want <= got and len(got) < 5 * len(want) + 50


def test_blocks_make_no_more_rows_than_they_read():
    """A block of near copies around the threshold: rows grow with its nodes, not with its pairs, and the links join what brute force joins."""
    rnd = np.random.default_rng(4)
    draw = lambda n: rnd.integers(0, 2**63, n).astype(np.uint64)
    base = draw(60)
    sets = [np.unique(np.concatenate([rnd.permutation(base)[: 60 - d], draw(d)])) for d in rnd.integers(2, 9, 300)]
    node = np.arange(len(sets)) * 3
    shared = {"block": np.full(len(sets), 7), "side": np.zeros(len(sets), np.int32), "node": node, "n": np.array([len(s) for s in sets]), "label": node}
    batch = lambda name, column: pa.RecordBatch.from_pydict(shared | {name: pa.array(column, pa.binary())})
    rows = lambda made: [r for b in made for r in b.to_pylist()]
    bitmaps = batch("bitmap", [zlib.compress(ngram_join._bitmap(s)) for s in sets])
    pairs = rows(ngram_join._tree_pairs(80)(iter([bitmaps])))
    assert len(pairs) <= len(sets) and {r["block"] for r in pairs} == {None, 7}
    members = rows(ngram_join._tree_members(80)(iter([bitmaps])))
    links = rows(ngram_join._tree_links(80)(iter([batch("shingles", [s.tobytes() for s in sets])])))
    assert len(members) <= len(sets) and len(links) < len(sets)
    up = {int(i): int(i) for i in node}

    def root(i):
        return i if up[i] == i else root(up[i])

    joined = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert all((max(r["a"], r["b"]) // 3, min(r["a"], r["b"]) // 3) in joined for r in links) and len(joined) > 10 * len(sets)
    for r in links:
        a, b = root(r["a"]), root(r["b"])
        assert a != b
        up[a] = b
    assert all(root(3 * a) == root(3 * b) for a, b in joined) and len({root(int(i)) for i in node}) > 1
    assert {r["node"] // 3 for r in members} >= {i for pair in joined for i in pair}


@pytest.mark.parametrize("branch", [2500, 1 << 20])
def test_join_of_copies_around_the_threshold(spark, monkeypatch, branch):
    """Of candidates left out of a block's forest, those that join what is still apart are verified in the block."""
    rnd = random.Random(9)
    words = [f"u{i}" for i in range(5000)]
    rows, base = [], [rnd.choice(words) for _ in range(60)]
    for i in range(200):
        t = list(base)
        for _ in range(rnd.choice([2, 3, 4, 5])):
            t[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(t), "s"))
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    monkeypatch.setattr(ngram_join, "BRANCH", branch)
    found, real = [], ngram_join._links_within
    monkeypatch.setattr(ngram_join, "_links_within", lambda *a: (found.append(real(*a)), found[-1])[1])
    got = ngram_join.linked_components(docs_of(spark, rows), 3, 75).collect()
    want = brute_components(rows, 3, 75)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(found) == 1 and (branch == 2500 or found[0].count() > 0) and len({c for _, c in want.values()}) > 1


def test_near_copies_and_empty_input(spark):
    rows = corpus(5)
    docs = docs_of(spark, rows)
    want = brute_components(rows, 5, 80)
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == [i for i in sorted(want) if want[i][1] == i]
    assert ngram_join.linked_components(docs.where("false")).count() == 0


def test_join_of_repeated_rows_and_null_ids(spark):
    """Copies are one node; a doc_id with several texts is one document; null ids are documents of their own."""
    words = [f"v{i}" for i in range(400)]
    rnd = random.Random(12)
    a, b, c = (" ".join(rnd.choice(words) for _ in range(40)) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " zz"
    rows = [(1, a, "s")] * 50 + [(i, b, "s") for i in range(10, 60)] + [(None, a, "s")] * 20 + [(None, near(b), "s")] * 3
    rows += [(70, near(a), "s"), (70, near(c), "s"), (70, "other words here", "s"), (80, c, "s"), (90, "other  words HERE", "s"), (None, "alone", "s"), (None, "apart", "s")]
    made = []
    real = ngram_join._links
    ngram_join._links = lambda pairs, nodes, *rest: (made.append(nodes.count()), real(pairs, nodes, *rest))[1]
    try:
        got = ngram_join.linked_components(docs_of(spark, rows), 3, 80).collect()
    finally:
        ngram_join._links = real
    assert made[0] == 9 and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert all(by[i] == {1} for i in (1, 70, 80, 90)) and all(by[i] == {10} for i in range(10, 60)) and by[None] == {1, 10, None}
    # the filter judges rows by their own texts: one row of each group stays, whatever its id
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = [ranked[i][0] for i, (_, root) in brute_components([(i, r[1]) for i, r in enumerate(ranked)], 3, 80).items() if i == root]
    kept = ngram_join.without_near_copies(docs_of(spark, rows), 3, 80).collect()
    assert [r[0] for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))] == want == [1, 10, 70, 70, None, None]
    assert {r[1] for r in kept} >= {a, b, "alone", "apart"}


def test_near_copies_of_clashing_columns_and_empty_texts(spark):
    """Empty and null texts stay, equal rows become one, and columns named like the operator's own are kept."""
    rows = [(1, "a b c d e f", 1, 5), (1, "a b c d e f", 1, 5), (2, "A b c d e f", 2, 6), (3, "", 3, 7), (3, "", 3, 7), (None, None, 4, 8), (4, "one", 5, 9), (None, "ONE", 6, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash long, node int")
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_links_of_a_hot_root_are_split(spark, monkeypatch):
    """A component with most of the links: adaptive execution may split the root's rows, and the result is right."""
    monkeypatch.setattr(components, "LINKS_AT_ONCE", 1000)
    n = 20_000
    links = spark.range(1, n).selectExpr("id AS a", "0L AS b").union(spark.createDataFrame([(n + 2, n + 1)], "a long, b long")).repartition(8)
    got = components.components(links)
    assert got.where("root = 0").count() == n and got.where(f"root = {n + 1}").count() == 2


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (2, 1), (20, 9)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and got[20] == got[9] == 8 and got[139] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9 exact dedup


def test_exact_dedup(spark):
    rows = corpus(2) + [(200 + i, "Hot TEXT é", "s") for i in range(50)] + [(300, "hot text é", "s"), (301, "hot text É", "s"), (7, corpus(2)[7][1], "s"), (None, "nul", "s")]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), counters=4).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    text = {i: low(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        own = groups[text[r["doc_id"]]]
        keep = max((x for x in own if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs_of(spark, rows).where("false")).count() == 0


def test_exact_dedup_just_under_the_counters_limit(spark):
    """A digest with rows / (counters + 1) copies need not be found frequent; it is counted like the rest."""
    rows = [(i, "hot", "s") for i in range(20)] + [(100 + i, f"t{i}", "s") for i in range(80)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_of(spark, rows), counters=4).collect()}
    assert len(got) == 100 and all((got[i]["keep_id"], got[i]["group_size"]) == (19, 20) for i in range(20)) and got[100]["group_size"] == 1


def test_misra_gries_guarantee():
    rnd = random.Random(6)
    items = [bytes([rnd.choice([1, 1, 1, 2, 2, rnd.randrange(3, 250)])]) for _ in range(5000)]
    parts = [pa.RecordBatch.from_arrays([pa.array(items[i : i + 500], pa.binary())], ["digest"]) for i in range(0, 5000, 500)]
    made = [b for p in parts for b in exact_dedup._summary(4)(iter([p]))]
    found = {d for b in exact_dedup._summary(4)(iter(made)) for d in b.column(0).to_pylist()}
    assert len(found) <= 4 and {d for d in set(items) if items.count(d) > 1000} <= found


# ---- 10 substring dedup


def test_repeated_passages_go_once(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(6)) for _ in range(4000)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = some(55), some(14)
    rows = []
    for i in range(40):
        t = some(80) + "\n" + some(30)
        if i % 4 == 1:
            t = f"{some(20)} {passage.upper() if i == 9 else passage} {some(25)}\n{some(15)}"
        if i % 4 == 2:
            t += "\n" + line.replace(" ", "  ") + "\n" + some(9)
        rows.append((i, t, "s"))
    rows += [(50, None, "s"), (51, "", "s"), (52, "short line", "s"), (53, "short line", "s"), (54, "x " * 40_000, "s")]
    docs = docs_of(spark, rows)
    spans = substring_dedup.repeated_spans(docs).collect()
    text = {i: t for i, t, _ in rows}
    assert {r["doc_id"] for r in spans} == {i for i in range(40) if i % 4 in (1, 2)} - {1, 2}
    squeeze = lambda t: " ".join(low(t).split())
    for r in spans:
        cut = squeeze(text[r["doc_id"]][r["start"] : r["end"]])
        assert (cut in passage or cut == line) and len(cut.split()) == r["n_words"] >= 10
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs).collect()}
    assert len(out) == len(rows) and out[0]["text"] == text[0] and out[50]["text"] is None
    for r in spans:
        assert len(out[r["doc_id"]]["text"]) == len(text[r["doc_id"]]) - sum(x["end"] - x["start"] for x in spans if x["doc_id"] == r["doc_id"])
    assert substring_dedup.repeated_spans(docs.where("false")).count() == 0


def slow_units(text, reach):
    """(words of a unit, start, end, is a whole line), word by word."""
    mask = (1 << 64) - 1

    def hashed(word):
        h, _ = textvec.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
        return int(h[0])

    def mixed(x):
        return int(textvec.mix(np.array([x & mask], np.uint64))[0])

    out, start = [], 0
    for line in re.finditer(r"[^\n]+", text):
        found = [(m.group(), line.start() + m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line.group())]
        if not found:
            continue
        h = [hashed(w) for w, _ in found]
        pair = [mixed(h[i] * 0x9FB21C651E98DF25 + h[i + 1]) for i in range(len(h) - 1)] + [mask]
        cuts = [i for i in range(reach, len(h) - reach) if all(pair[i] < pair[j] for j in range(i - reach, i)) and all(pair[i] <= pair[j] for j in range(i + 1, i + reach + 1))]
        ends = [*cuts, len(h) - 1]
        for lo, hi in zip([0, *[c + 1 for c in cuts]], ends):
            out.append((tuple(low(w) for w, _ in found[lo : hi + 1]), start, found[hi][1], not cuts))
            start = found[hi][1]
    return out


def test_spans_against_brute_force_and_any_dealing(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeÉ") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [some(rnd.randint(3, 60)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = "".join(rnd.choice([some(rnd.randint(1, 30)), rnd.choice(passages), rnd.choice(passages).upper()]) + rnd.choice([" ", "\n", "\n\n", "  "]) for _ in range(rnd.randint(1, 7)))
        rows.append((rnd.choice([i, i, i, None, 2**63 - 1]), t, "s"))
    rows += [(3, None, "s"), (4, "", "s"), (5, rows[0][1], "s"), (5, rows[0][1], "s")]
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j))
    seen, want, kept_text = set(), [], {}
    for j in order:
        gone = []
        for unit, start, end, line in slow_units(rows[j][1] or "", 4):
            if unit in seen:
                gone.append((start, end, len(unit), line))
            seen.add(unit)
        runs = []
        for g in gone:
            if runs and runs[-1][-1][1] == g[0]:
                runs[-1].append(g)
            else:
                runs.append([g])
        spans = []
        for run in runs:
            if sum(g[2] for g in run) >= 10:
                spans.append((run[0][0], run[-1][1], sum(g[2] for g in run)))
                continue
            for g in run:  # whole lines only; those that touch are one span
                if g[3] and spans and spans[-1][1] == g[0]:
                    spans[-1] = (spans[-1][0], g[1], spans[-1][2] + g[2])
                elif g[3]:
                    spans.append(g[:3])
        want += [(rows[j][0], *s) for s in spans]
        t = rows[j][1]
        for s in reversed(spans):
            t = t[: s[0]] + t[s[1] :]
        kept_text[j] = t
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert len(want) > 60
    one = spark.createDataFrame([(i, t, "en", s, 0, "x", j) for j, (i, t, s) in enumerate(rows)], DOCS).coalesce(1).sortWithinPartitions("node")
    for docs in (one, one.repartitionByRange(7, "node").sortWithinPartitions("node")):
        got = [(r["doc_id"], r["start"], r["end"], r["n_words"]) for r in substring_dedup.repeated_spans(docs, short_lines=True).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        out = substring_dedup.without_repeats(docs.withColumn("removed", F.lit(1)).withColumn("_key", F.lit("k")), short_lines=True)
        assert out.columns == [*docs.columns, "removed", "_key", "removed_"]
        assert {r["node"]: r["text"] for r in out.collect()} == kept_text
    texts = substring_dedup.without_repeats(one.withColumn("doc_id", F.col("doc_id").cast("string")), short_lines=True)
    assert texts.count() == len(rows)


def test_repeated_short_lines_go_whatever_their_length(spark, tmp_path):
    from vertexloom.llm import queries

    rnd = random.Random(8)
    lines = ["Released under the MIT license.", "ok", " All  rights reserved ", "one two three four five six seven eight nine"]
    fresh = lambda: " ".join("".join(rnd.choice("abcdefghijk") for _ in range(8)) for _ in range(rnd.randint(1, 9)))
    rows = [(i, "\n".join(fresh() if rnd.random() < 0.5 else rnd.choice(lines) for _ in range(rnd.randint(1, 12))), "s") for i in range(60)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), {}
    for i, t, _ in rows:
        at = 0
        for line in t.split("\n"):
            u = " ".join(low(line).split())
            if u in seen:
                want.setdefault(i, set()).update(range(t.index(line, at), at + len(line.rstrip())))
            seen.add(u)
            at += len(line) + 1
    got = {}
    for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    text = {i: t for i, t, _ in rows}
    solid = lambda spans: {i: {p for p in at if not text[i][p].isspace()} for i, at in spans.items()}
    assert solid(got) == solid(want)


# ---- hashes


@pytest.mark.parametrize(("ends", "pattern"), [(textvec.SPACES, r"[^\x20\x09-\x0D]+"), (textvec.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize(("k", "short"), [(3, True), (5, False)])
def test_shingle_sets_equal_sets_of_words(monkeypatch, ends, pattern, k, short):
    monkeypatch.setattr(textvec, "PIECE", 300)
    rnd = random.Random(k)
    texts = [None, ""] + ["".join(rnd.choice(["a", "B", "é", "中", " ", "\n", ".", "0", "\x00", "😀", "\x0b"]) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    seen = {}
    for row, s in textvec.shingle_sets(pa.array(texts), k, ends, short):
        w = re.findall(pattern, low(texts[row]))
        want = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w and short else frozenset())
        assert len(want) == len(s) and seen.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)


# ---- pipeline


def test_pipeline_stages_on_a_small_corpus(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        assert docs.columns == columns
        now = docs.count()
        assert now <= n and (name != "mixing" or now == n)
        n = now
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n


def test_pipeline_shards_keep_the_mixed_order(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, f"text {i // 2 if i % 10 == 0 else i} " * (1 + i % 7), ["a", "a", "a", "b", None][i % 5]) for i in range(1500)]
    docs_of(spark, rows, 7).write.parquet(f"{tmp_path}/documents.parquet")
    position = {r["doc_id"]: r["position"] for r in mixing.mix(corpus_pipeline.table(spark, str(tmp_path), "documents")).collect()}

    def slots(names):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in stages if s[0] in names])
        by_shard = {}
        for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
            by_shard.setdefault(r["shard"], {})[r["slot"]] = r["doc_id"]
        assert sum(map(len, by_shard.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
        return {k: [s[i] for i in range(len(s))] for k, s in by_shard.items()}

    stages = corpus_pipeline.STAGES
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        mixed, plain = slots(["mixing", "sharding"]), slots(["sharding"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(s == sorted(s, key=position.get) for s in mixed.values())
    assert {k: set(s) for k, s in mixed.items()} == {k: set(s) for k, s in plain.items()} and mixed != plain
