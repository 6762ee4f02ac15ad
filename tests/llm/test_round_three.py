"""Long unbroken texts for the search of entities; repeated and null ids for the mix."""

import collections
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann, licenses, mixing, pii, toxicity

N = 200_000
UNBROKEN = {
    "letters": "7" + "a" * N, "digits": "1" * N, "dots": "." * N + "1", "labels": "x@" + "a." * N, "ats": "a@" * N, "initials": "Mr " + "A. " * N, "colons": "1:" * N,
    "base64": "7" + "aB3/+" * N, "hex": "a1" * N, "keys": "sk-" * N, "dashes": "1-" * N, "titles": "Mr " * N, "blanks": " " * N + "1", "accounts": "DE12 " * N,
}


def test_entities_are_found_in_linear_time(spark):
    df = spark.createDataFrame(list(UNBROKEN.items()), "kind string, text string").repartition(4)
    df.limit(1).select(pii.entities_in(F.col("text"))).collect()
    began = time.perf_counter()
    got = {r.kind: r.n for r in df.select("kind", F.size(pii.entities_in(F.col("text"))).alias("n")).collect()}
    assert time.perf_counter() - began < 60 and set(got) == set(UNBROKEN)


def test_entities_side_by_side(spark):
    text = "+1 555 123 4567x@y.com a@b.com..xx <q-r@w.co.uk> z@" + "a." * 130 + "com me@host.c1 you@b.com1"
    found = spark.createDataFrame([(text,)], "text string").select(pii.entities_in(F.col("text")).alias("e")).first().e
    # A domain has at most 127 labels; one that goes on without a last label among them is none.
    assert found == ["+1 555 123 4567", "x@y.com", "a@b.com", "q-r@w.co.uk", "you@b.com"]


@pytest.mark.parametrize("ids", ["repeated", "null"])
def test_mix_of_repeated_ids(spark, ids):
    """One id holds many rows; the taken words stay within its group of the target, and SQL agrees."""
    rng = random.Random(1)
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(300)] + [(7 if ids == "repeated" else None, "w " * 12, "s0")] * 500
    rows += [(1000 + i, "w " * rng.randint(1, 30), None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(df).collect()
    taken, target, group = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        group[r.source, r.doc_id] += r.size
        assert 0 <= r.taken <= 2 * r.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(n for (of, _), n in group.items() if of == s)
    con = duckdb.connect()
    con.register("documents", pa.table({c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "text", "source"))}))
    names = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in names)) for r in got)


def test_long_conversations(spark):
    """Conversations of 1, 2, 15, 16, 17 and 20,000 turns against the format written out in Python."""
    from tideline.llm import chat

    rows, wanted = [], {}
    for conv, n in enumerate((1, 2, 15, 16, 17, 20_000)):
        turns = [(i, ("user", "assistant", "assistant", "sys\ntem", "")[i * i % 5], f"{i} \\ <|im_sep|> {'ä𝄞x' * (i % 7)}") for i in range(n)]
        out, spans, before = "", [], None
        parts, at = [], 0
        for _, role, text in turns:
            quoted = text.replace("\\", "\\\\").replace("<|", "<\\|")
            head = "<|im_sep|>" if role == before else ("" if before is None else "<|im_end|>\n") + "<|im_start|>" + role.replace("\n", "\\n") + "\n"
            parts += [head, quoted]
            at += len(head) + len(quoted)
            if role == "assistant":
                spans.append((at - len(quoted), at))
            before = role
        out = "".join(parts) + "<|im_end|>\n"
        wanted[conv] = (out, spans, [(r, t) for _, r, t in turns], "".join(t for _, r, t in turns if r == "assistant"))
        rows += [(conv, *t) for t in turns]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3))
    got = {r.conv_id: (r.formatted, [tuple(s) for s in r.spans]) for r in made.collect()}
    assert got == {c: w[:2] for c, w in wanted.items()}
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(made).collect()}
    assert back == {c: w[2:] for c, w in wanted.items()}


def test_lists_of_two_levels(spark):
    """More lists than the sample has rows for: pairs of centres, ranked as the distances to their sums; recall holds."""
    rng = np.random.default_rng(1)
    index = {"centres": rng.standard_normal((6, 8)), "finer": rng.standard_normal((5, 8))}
    q = rng.standard_normal((40, 8))
    sums = (index["centres"][:, None] + index["finer"][None]).reshape(-1, 8)
    assert ann.n_lists(index) == 30 and (ann.by_nearness(index, q, 4) == ((q[:, None] - sums[None]) ** 2).sum(2).argsort(1)[:, :4]).all()
    lists = ann.lists_of(index, q)
    assert (lists // 5 == ((q[:, None] - index["centres"]) ** 2).sum(2).argmin(1)).all() and len(set(lists)) > 6

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    fitted = ann.fit(ann.valid(e), 1_200, 300, 10, 0.97)
    assert fitted["centres"].shape[0] == 30 and fitted["finer"].shape[0] == 10 and 1 <= fitted["probes"] <= 300
    p = e.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.values
    out = ann.search(e, F.col("vec_id") % 100 == 0, sample=1_200, lists=300).toPandas()
    assert (out.groupby("query_id").size() == 10).all() and set(out.query_id) == set(ids[ids % 100 == 0])
    hit = 0
    for query, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
        d[ids == query] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g.vec_id))
    assert hit >= 0.9 * len(out)

    # Queries short of neighbours go on to more lists until none is left.
    few = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((90, 6)))], "vec_id long, embedding array<double>")
    found = ann.search(few, F.col("vec_id") == 7, k=89, lists=8, recall=0.01).toPandas()
    assert list(found["rank"]) == list(range(1, 90)) and found.score.is_monotonic_increasing


#: wordings in no template; written after the names were, and not changed since
HELD_OUT = (
    ("apache-2.0", "The tools come under the Apache License, Version 2.0, as do the examples."),
    ("apache-2.0", "We publish our work under the terms of the Apache License 2.0 and welcome changes."),
    ("apache-2.0", "See the Apache License, Version 2.0, for the specific language governing permissions and limitations."),
    ("mit", "Use it as you like: MIT License."),
    ("mit", "The site and its scripts are covered by the MIT License (see below)."),
    ("mit", "Subject to the MIT licence, copies may be sold."),
    ("gpl-3.0", "The program comes with the GNU General Public License, version 3, and without warranty."),
    ("gpl-3.0", "You may copy it under GNU GPL version 3 or later."),
    ("gpl-3.0", "A copy of the GNU General Public License should have come along with this program."),
    ("bsd", "The parser is offered under the 3-Clause BSD License."),
    ("bsd", "Neither the name of the holder nor the names of contributors may be used to endorse products."),
    ("bsd", "This is software under a BSD License with three clauses."),
    ("cc-by-nc-4.0", "Photographs by the museum, CC BY-NC 4.0, not for sale."),
    ("cc-by-nc-4.0", "Reuse under Creative Commons Attribution-NonCommercial 4.0 only."),
    ("cc-by-4.0", "Data of the survey: CC BY 4.0, please cite."),
    ("cc-by-4.0", "Published as open access under Creative Commons Attribution 4.0."),
    ("proprietary", "2021 The Press. All rights reserved, including translation."),
    ("proprietary", "Nothing here may be copied without the written permission of the owner."),
    ("", "Version 3 of the general plan was made public under the new law."),
    ("", "The rights of all readers are reserved to the library."),
    ("", "A driver's license is free of charge for the public."),
    ("", "The old common house met the conditions of the city without warranty."),
    ("", "4.0 of the creative works were by the author."),
    ("", "The permission notice is in the source of the river."),
)


def test_licences_in_held_out_wordings(spark):
    """Wordings unlike the templates', alone and inside documents; probabilities mean what they say."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = licenses.train(docs)
    rows = [(i, t) for i, (_, t) in enumerate(HELD_OUT)] + [(100 + i, f"A note.\n\n{t}\n\nmore of it") for i, (_, t) in enumerate(HELD_OUT)]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    for base in (0, 100):
        hit = sum(got[base + i] == [f] for i, (f, _) in enumerate(HELD_OUT) if f)
        assert hit >= 0.55 * sum(bool(f) for f, _ in HELD_OUT)
        assert not any(got[base + i] for i, (f, _) in enumerate(HELD_OUT) if not f)
        assert all(got[base + i] in ([], [f]) for i, (f, _) in enumerate(HELD_OUT) if f)

    # Reliability over variants amid lines of documents that the model has not seen, and over such lines.
    rng = np.random.default_rng(8)
    lines = [r.text.split("\n")[0][:2_000] for r in docs.where("text IS NOT NULL AND doc_id % 5 = 3").orderBy("doc_id").select("text").limit(1_500).collect()]
    lines = [t for t in lines if t.strip() and max(licenses.similarity(t, f) for f in licenses.TEMPLATES) < 0.6]
    texts, y = licenses._variants(rng, 6)
    texts, y = licenses._amid(rng, texts, lines) + lines, np.array(y + [len(licenses.FAMILIES) - 1] * len(lines))
    p = np.zeros((len(texts), len(licenses.FAMILIES)))
    p[:, -1] = 1  # fewer than two words of any template
    at, scored = model.predict(next(licenses.blocks(pa.array(texts), most_bytes=1 << 40)))
    p[at] = scored
    sure, right = p.max(1), p.argmax(1) == y
    bins = np.digitize(sure, [0.5, 0.6, 0.7, 0.8, 0.9])
    off = sum(abs(sure[bins == b].sum() - right[bins == b].sum()) for b in range(6)) / len(y)
    assert off <= 0.05 and right[y < len(licenses.FAMILIES) - 1].mean() >= 0.9


def test_chain_from_telling_words_equals_the_chain_from_all(spark):
    """The words that stay on the executors are those that no model keeps."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    named = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.when(F.col("doc_id") % 7 > 0, F.col("toxic")).alias("toxic"))
    chain = toxicity.train(docs, named, ("low_quality", "toxic"))
    order = toxicity.hash_sample(named.select("doc_id"), "doc_id", 6_000, 5).select("doc_id", "o")
    rows = docs.join(named, "doc_id").join(order, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(c).alias(c) for c in ("o", "low_quality", "toxic"))).orderBy("o", "doc_id").toPandas()
    block = next(toxicity.blocks(pa.array(rows.text), letters_only=True, most_bytes=1 << 40))
    doc, bucket = toxicity.features(block)
    y = rows[["low_quality", "toxic"]].to_numpy(dtype=float)
    assert np.isnan(y[:, 1]).any()
    for got, wanted in zip(chain, toxicity.fit_chain(doc, bucket, y, toxicity.folds(toxicity._marks(block)))):
        assert list(got.words) == list(wanted.words) and len(got.words) and got.cut == wanted.cut
        assert np.array_equal(got.weights, wanted.weights) and np.array_equal(got.rest, wanted.rest)
    none = toxicity.train(docs, named.limit(0), ("low_quality", "toxic"))
    assert [len(m.words) for m in none] == [0, 0]
