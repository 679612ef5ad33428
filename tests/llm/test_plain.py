"""Operators and the pipeline against plain versions that share no code with them."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholion.llm import chat, decontaminate, fingerprint, licenses, packing, pii, quality, queries, secrets, simhash, toxicity
from scholion.llm.common import materialize, table
from tests.llm.test_brute_force import PUBLISHED, least_reachable

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_fingerprint(text, k=8, width=2, sketches=64):
    """Order MinHash in Python's own integers."""
    if not text:
        return [0] * sketches
    seen, kmers = Counter(), []
    for at in range(max(1, len(text) - k + 1)):
        value = 0
        for c in text[at : at + k]:
            value = value * 0x100000001B3 + ord(c) + 1 & MASK
        value = mixed(value * 0x9E3779B97F4A7C15 & MASK) >> 20
        kmers.append(mixed(value * 0x9E3779B97F4A7C15 + seen[value] * 0xD6E8FEB86659FD93 & MASK))
        seen[value] += 1
    out = []
    for j in range(1, sketches + 1):
        by = mixed(j * 0x9E3779B97F4A7C15 & MASK) >> 32 | 1

        def rank(at):
            x = (kmers[at] >> 32) * by & 0xFFFFFFFF
            return (x ^ x >> 15) * 0x85EBCA6B & 0xFFFFFFFF, at

        least = sorted(sorted(range(len(kmers)), key=rank)[:width])
        value = len(least)
        for at in least:
            value = mixed((value ^ kmers[at]) * 0x9E3779B97F4A7C15 & MASK)
        out.append(value >> 32)
    return out


def test_fingerprints_in_plain_integers():
    rng = random.Random(14)
    for n in (0, 1, 5, 8, 9, 40, 300):
        text = "".join(rng.choices("ab cdé\U0001f600", k=n))
        assert fingerprint.order_minhash(text).tolist() == plain_fingerprint(text)


@pytest.mark.parametrize("n", [250, 1015, 4090])
def test_lengths_do_not_change_kmers(n):
    """A text and the text with a few more code points are alike, whatever powers of two lie between their lengths."""
    text = "".join(random.Random(n).choices("abcdefgh ", k=n))
    assert fingerprint.likeness(fingerprint.order_minhash(text), fingerprint.order_minhash(text + "abcdefghijklm")) > 0.8


def test_long_texts_have_the_same_kmers():
    text = "".join(random.Random(3).choices("abcdefghij", k=(1 << fingerprint._PLACE_BITS) + 500))
    long, short = (set(fingerprint.numbered_kmers(x)[0].tolist()) for x in (text, text[:3000]))
    assert short <= long


def test_rows_of_one_id_follow_by_hash(spark):
    """An id that fills several ranges is cut by hashes, and its rows still follow one another in order."""
    rows = [(None, f"text number {k}") for k in range(400)] + [(5, "five"), (5, "five"), (7, "seven")]
    got = fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({x for x in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    want = Counter()
    for (name, text), (_, then) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(text) // 4
        want[name, hashlib.sha256((text[: len(text) - cut] + then[:cut]).encode()).hexdigest()] += rows.count((name, text))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def plain_sentences(text):
    text += " "
    text = re.sub(r"SPDX(-License-Identifier:[^\n]*)", r". Spdx\1.", text)
    wrap = r"[ \t]*\n[ \t]*(?:[#*]|//|--)?[ \t]*"
    text = re.sub(wrap + r'([a-z("])', r" \1", text)
    for _ in range(2):
        text = re.sub(r"([A-Za-z,])" + wrap + r"([A-Z]{4,})", r"\1 \2", text)
    for _ in range(2):
        text = re.sub(f"(GNU|General|Lesser|Affero|Mozilla|Public|Free){wrap}(General|Lesser|Affero|Public|License|Software)", r"\1 \2", text)
    text = re.sub(r"(^|[^A-Za-z0-9])([vV])\.", r"\1\2", text)
    for part in re.split(r"[.;][ \t\n\x0b\f\r]|\n", text):
        words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), part))
        if words:
            yield " ".join(words)


def plain_licences(text):
    names = []
    for sentence in plain_sentences(text or ""):
        sentence = re.sub(licenses.UNDER, "under ", sentence).removeprefix("the ")
        for spelled, word in licenses.SPELLINGS:
            sentence = sentence.replace(spelled, word)
        if sentence in licenses.known():
            names.append(licenses.known()[sentence])
    found, at = [], 0
    while at < len(names):
        rule = next((x for x in licenses.RULES if tuple(names[at : at + len(x[1])]) == x[1]), None)
        if rule:
            found.append((at, rule[0]))
        at += len(rule[1]) if rule else 1
    return names, found


def test_licences_of_every_document(spark, sf, docs):
    cases = dict(docs) | {-1 - k: x for k, x in enumerate(PUBLISHED.values())}
    cases[-100] = "All rights\nreserved. This work is in the public\ndomain. Licensed under CC BY. Licensed under the BSD license."
    cases[-101] = "SPDX-License-Identifier: GPL-2.0-only\nx\n// SPDX-License-Identifier: LGPL-2.1-or-later\n"
    cases[-102] = "This project is released under the terms of the GNU Lesser General Public License v2.1 or later. Licensed under the GNU Affero General Public License."
    cases[-103] = "Dual licensed under the GPLv3; licensed under the GNU General Public License, version 2 only. Made available under a Creative Commons Attribution-NonCommercial 4.0 International License."
    got = {r["doc_id"]: (r["identifiers"], [tuple(x) for x in r["found"]]) for r in licenses.scan_licences(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert got == {k: plain_licences(x) for k, x in cases.items()}
    said = {k: [x for _, x in got[k][1]] for k in got}
    assert said[-100] == ["All-Rights-Reserved", "LicenseRef-Public-Domain", "LicenseRef-CC-BY", "LicenseRef-BSD"]
    assert said[-101] == ["GPL-2.0-only", "LGPL-2.1-or-later"]
    assert said[-102] == ["LGPL-2.1-or-later", "LicenseRef-AGPL"]
    assert said[-103] == ["GPL-3.0", "GPL-2.0-only", "CC-BY-NC-4.0"]


LESSER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_more_published_notices(spark):
    cases = [LESSER, LESSER.replace("library", "program").replace("Lesser", "Affero").replace("2.1", "3")]
    got = licenses.scan_licences(spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")).collect()
    assert [[x["licence"] for x in r["found"]] for r in sorted(got)] == [["LGPL-2.1-or-later"], ["AGPL-3.0-or-later"]]


def test_markov_spans_of_every_document(spark, docs):
    samples = secrets.labelled_samples(spark, 600)
    counts = {0: defaultdict(Counter), 1: defaultdict(Counter)}
    for r in samples.collect():
        for a, b in itertools.pairwise(r["text"]):
            if all(43 <= ord(c) <= 122 for c in a + b):
                counts[r["random"]][a][b] += 1
    used = len({b for label in counts.values() for row in label.values() for b in row})

    def ratio(run):
        total = 0.0
        for a, b in itertools.pairwise(run):
            logs = [math.log((counts[k][a][b] + 1) / (sum(counts[k][a].values()) + used)) for k in (1, 0)]
            total += round(logs[0] - logs[1], 5)
        return total

    kinds = [re.compile(r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")]
    texts = dict(docs) | {-1: "x " + "".join(random.Random(2).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=500)) + " alpha_customer_delivery_invoice"}
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == "markov"] for r in secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), secrets.train(samples)).collect()}
    for name, text in texts.items():
        covered = set()
        for k, kind in enumerate(kinds):
            for m in kind.finditer(text):
                if k or len(m[1]) >= 6:
                    covered.update(range(*m.span()))
        want = []
        for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            at = run.start()
            for inside, part in itertools.groupby(range(*run.span()), key=lambda x: x in covered):
                n = len(list(part))
                if not inside and n >= 20 and ratio(text[at : at + n]) >= secrets.MARGIN:
                    want.append((at, at + n))
                at += n
        assert got[name] == want, name
    assert got[-1]


def test_spans_of_many_matches(spark):
    from scholion.llm.spans import matches

    text = "".join(random.Random(1).choices(["ab", " ", "é", "\U0001f600", "abab"], k=5000))
    got = spark.createDataFrame([(text,), ("",), (None,)], "x string").select(matches(F.col("x"), "ab").alias("y")).collect()
    assert [(x["start"], x["end"]) for x in got[0]["y"]] == [m.span() for m in re.finditer("ab", text)] and not got[1]["y"] and not got[2]["y"]


def test_toxicity_by_plain_cosines(spark, sf, docs):
    """Evidence and scores of all documents, from dense vectors of all terms."""
    frame, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit_toxicity(frame, labels)
    examples = [docs[x] for x in model.names]

    def terms(text):
        return Counter(y for word in re.findall(r"[^\W\d_]+", text.lower()) for y in (word, *(f"^{word[:k]}" for k in (4, 5) if len(word) > k)))

    used = [terms(x) for x in examples]
    df = Counter(y for x in used for y in x)
    assert set(df) == set(model.terms) and [df[x] for x in sorted(model.terms, key=model.terms.get)] == sorted(df.values(), reverse=True)

    def vector(text):
        out = np.zeros(len(model.terms))
        for term, n in terms(text).items():
            if term in model.terms:
                out[model.terms[term]] = (1 + math.log(n)) * model.worth[model.terms[term]]
        return out / max(np.linalg.norm(out), 1e-300)

    dense = np.stack([vector(x) for x in examples])
    for r in toxicity.classify_toxicity(frame, labels).collect():
        cosine = np.round(dense @ vector(docs[r["doc_id"]]), 9)
        order = sorted(range(len(examples)), key=lambda k: (-cosine[k], k))
        near = [k for k in order if cosine[k] > 0][: toxicity.NEIGHBOURS]
        got = [model.names.index(x) for x in r["evidence"]]
        assert len(got) == len(near) and np.allclose(cosine[got], cosine[near], atol=2e-9)
        if near:
            weights = model.votes[got] / (0.05 + np.arccos(np.clip(cosine[got], 0, 1)))
            assert abs(np.interp((weights * model.labels[got]).sum() / weights.sum(), *model.steps) - r["score"]) < 1e-5


def test_quality_does_not_depend_on_the_batch(spark, sf, docs):
    model = quality.fit_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    texts = list(docs.values())[:60]
    together = model.score(texts * 5)
    assert together.tolist() == [model.score([x])[0] for x in texts] * 5
    # plain: the nearest of rounded cosines, ties by the sampled row's place
    for text, score in zip(texts[:20], together, strict=False):
        cosine = np.round(model.project(quality._shares(quality.term_counts(text)[None, :]))[0] @ model.vectors.T, 9)
        near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: quality.NEIGHBOURS]
        weight = [max(cosine[k], 0) ** quality.SHARPNESS * model.votes[k] for k in near]
        assert abs(sum(w for w, k in zip(weight, near, strict=True) if model.labels[k]) / sum(weight) - score) < 1e-8


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(words, items, window=10):
    wanted = defaultdict(set)
    for name, own in items.items():
        n = min(window, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            wanted[tuple(own[at : at + n])].add(name)
    hit, found = set(), set()
    for n in {len(x) for x in wanted}:
        for at in range(len(words) - n + 1):
            if names := wanted.get(tuple(words[at : at + n])):
                hit.update(range(at, at + n))
                found |= names
    return len(words), len(hit), sorted(found)


def test_windows_in_several_passes(spark, sf, docs):
    items = {str(r["item_id"]): plain_words(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    some = dict(list(docs.items())[:60]) | {-1: "the of", -2: "ethe", -3: None, -4: "", -5: " ".join(next(iter(items.values()))[:12]) * 2}
    extra = {"a": ["the"], "b": ["of", "the"], "c": ["x"] * 10}
    some[-6] = "x " * 40
    frame = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in (items | extra).items()], "item_id string, text string")
    for pairs_at_once in (150, 200_000):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(frame, bench, pairs_at_once=pairs_at_once).collect()}
        assert got == {k: plain_hits(plain_words(x), items | extra) for k, x in some.items()}
    clean = {k for k, x in got.items() if not x[1]}
    for broadcast_keys in (0, 1000):
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench, broadcast_keys=broadcast_keys).collect()} == clean


def test_many_windows(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)]
    items = {str(k): rng.choices(words, k=110) for k in range(2000)}
    some = {k: rng.choices(words, k=200) for k in range(40)}
    for k in range(0, 40, 4):
        some[k][50:62] = items[str(k)][20:32]
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in some.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(frame, bench, pairs_at_once=100_000).collect()}
    assert got == {k: (200, 12, [str(k)]) if k % 4 == 0 else (200, 0, []) for k in some}


def test_a_wrong_loss_mask_is_seen(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b c")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns)
    assert chat.read_back(formatted).first()["loss_chars"] == 3
    for change in ("loss_end - 1", "loss_end + 1", "NULL"):
        with pytest.raises(Exception, match="loss mask"):
            chat.read_back(formatted.withColumn("loss_end", F.expr(change)).withColumn("loss_start", F.expr("IF(loss_end IS NULL, NULL, loss_start)"))).collect()


def plain_shingle_prints(text, words, tables):
    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not found:
        return [0] * tables
    hashes = [xxhash.xxh64_intdigest(" ".join(found[k : k + words]).encode(), 42) for k in range(max(1, len(found) - words + 1))]
    out = []
    for t in range(tables):
        if t:
            hashes = [x * 0x9E3779B97F4A7C15 & MASK for x in hashes]
            hashes = [(x ^ x >> 32) * 0xBF58476D1CE4E5B9 & MASK for x in hashes]
            hashes = [x ^ x >> 29 for x in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def plain_groups(texts, words, tables):
    """The least id that each reaches by links in any table."""
    prints = {k: plain_shingle_prints(x or "", words, tables) for k, x in texts.items()}
    root = {k: k for k in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if any((x ^ y).bit_count() <= 4 for x, y in zip(prints[a], prints[b], strict=True)):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: top(k) for k in texts}


@pytest.mark.parametrize("tables", [1, 3])
def test_links_of_any_table(spark, docs, tables):
    rng = random.Random(8)
    some = dict(list(docs.items())[:40])
    for k, text in list(some.items()):
        words = text.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        some[k + 10_000] = " ".join(words)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(some.items()), "doc_id long, text string"), words=5, tables=tables).collect()}
    assert got == plain_groups(some, 5, tables)


def test_components_of_random_graphs(spark):
    rng = random.Random(21)
    for n, m in ((60, 40), (200, 190), (300, 290)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        if n == 300:  # a path whose nodes are numbered at random
            order = rng.sample(range(n), n)
            pairs = list(itertools.pairwise(order))
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        nodes = {x for pair in pairs for x in pair}
        root = {x: x for x in nodes}
        for _ in nodes:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        assert got == root


def test_last_steps_differ_by_one_sequence():
    given = []
    packer = packing.Packer(0, lambda *x: given.append(x), 4096, packing.TIERS, packing.STEP_TOKENS)
    rng = random.Random(3)
    for k in range(300):
        packer.add(k, rng.choice([3, 90, 400, 700, 1500, 2500, 5000, 9000]))
    packer.finish()
    groups = defaultdict(Counter)
    for (length, _, _), _, _, tier, group, _ in given:
        groups[tier][group] += length
    for tier, sums in groups.items():
        assert max(sums.values()) - min(sums.values()) <= tier and tier & (tier - 1) == 0 and max(sums.values()) <= max(packing.STEP_TOKENS, tier)


def valid_iban(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_surrogates_keep_what_is_around_them(spark):
    texts = [
        "Growth of +250 points and +123 more; call +49 30 1234567.",
        "DE89 3704 0044 0532 0130 00 and DE89370400440532013000, but GB82 WEST 1234 5698 7654 33 is wrong.",
        "Herr Max Weber kam. Max Weber blieb, Weber auch; Webers nicht. Erika Weber!",
        "Weber und Max Weber.",
        "Η κυρία Ελένη Παππά ήρθε.",
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[0]["text"].startswith("Growth of +250 points and +123 more; call +49 ") and [x["kind"] for x in got[0]["pii"]] == ["phone"]
    a, b, c = (x["surrogate"] for x in got[1]["pii"])
    assert valid_iban(a) and a.replace(" ", "") == b and a[:2] == "DE" and a[2:].replace(" ", "") != texts[1][2:27].replace(" ", "") and not valid_iban(texts[1][56:83])
    kinds = [x["kind"] for x in got[2]["pii"]]
    names = [x["surrogate"] for x in got[2]["pii"]]
    assert kinds == ["name"] * 4 and names[0] == f"Herr {names[1]}" and names[1].split()[-1] == names[2] == names[3]
    assert "Weber " not in got[2]["text"] and "Webers" in got[2]["text"] and "Erika " in got[2]["text"]
    assert got[3]["text"] == texts[3]
    assert re.fullmatch(r"Η κυρία [Α-Ωα-ωάέήίόύώ -]+ ήρθε\.", got[4]["text"]) and "Παππά" not in got[4]["text"]


def test_surrogates_of_all_documents_are_distinct(spark, sf, docs):
    mentions = table(spark, sf, "documents").select(F.regexp_extract_all("text", F.lit(pii.PATTERN), F.lit(0)).alias("x")).select(F.explode("x").alias("found"))
    parts = mentions.select(F.explode(pii.parts_of(F.col("found"))).alias("x")).select("x.*")
    entities = {(r["kind"], r["canon"]) for r in parts.collect()}
    cores = {(r["kind"], r["canon"]): r["core"] for r in pii.surrogates(parts, "other key").collect()}
    assert set(cores) == entities and len({(k, core) for (k, _), core in cores.items()}) == len(entities)
    real = {(k, canon.lower()) for k, canon in entities}
    assert not [x for (k, _), x in cores.items() if (k, x.lower()) in real]


def test_the_pipeline_stage_by_stage(spark, sf):
    """Each stage's rows from the rows before it, by plain versions; then the whole run."""
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf, "documents")
    kept = materialize(stages["quality"](spark, docs, sf), "test")
    judged = {r["doc_id"] for r in queries.queries()["op9_quality"](spark, sf).collect() if r["predicted"] == 1}
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(before) == judged and len(before) < docs.count()

    unique = materialize(stages["near_duplicates"](spark, kept, sf), "test")
    groups = plain_groups(before, 5, corpus_pipeline.TABLES)
    after = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert after == {k: before[k] for k in before if groups[k] == k} and len(after) < len(before)

    clean = materialize(stages["decontamination"](spark, unique, sf), "test")
    items = {str(r["item_id"]): plain_words(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left == {k: x for k, x in after.items() if not plain_hits(plain_words(x), items)[1]} and len(left) < len(after)

    private = materialize(stages["privacy"](spark, clean, sf), "test")
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    addresses = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
    assert set(texts) == set(left) and any(addresses.search(x) for x in left.values())
    for k, x in texts.items():
        gone = addresses.findall(left[k])
        assert len(addresses.findall(x)) == len(gone) and not set(gone) & set(addresses.findall(x))
        assert x == left[k] or gone or re.search(r"\d{3}|Mr|Ms|Frau|Herr|Mme|Madame|Monsieur|Señor", left[k])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = corpus_pipeline.run(spark, sf).collect()
    want = {k: len(tokenizer.encode(x, add_special_tokens=False).ids) + 1 for k, x in texts.items()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    assert {k: sum(n for _, n in x) for k, x in pieces.items()} == want
    assert all(at == sum(n for _, n in sorted(x)[:i]) for x in pieces.values() for i, (at, _) in enumerate(sorted(x)))
