"""Fill-in-the-middle, collocations and language identification against plain versions, with nulls, odd texts, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import collocations, fill_middle, lang_id
from contactloom.llm.perfect_hash import PerfectHash, build, part_of

RNG = np.random.default_rng(11)


def some_docs(spark):
    words = [f"w{k}" for k in range(30)] + ["New", "York", "ÉTÉ", "été", "x y", "longer-than-eight-bytes", "longer-than-eight-bytez"]
    texts = [" ".join(RNG.choice(words, 60)).replace("w3 ", "w3, ").replace("w4 ", "w4\t ").replace("w5 ", "w5\n") for _ in range(60)]
    texts += ["new york  city. NEW\tYORK CITY; new york! city"] * 12 + ["", None, "a", " ", "...", "a a a a", "\x01\x02\x03\x04 \x01", "x <P> y", "<<S", "\U0001f600é" * 5, "long " * 20_000]
    rows = [(k, t, ["en", "de", None][k % 3], "s") for k, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "new york city", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n string").withColumns({"rank": F.lit(1), "marked": F.lit("m"), "fim2": F.lit(0), "h1": F.lit(7)}).repartition(3)


def test_fill_middle(spark):
    docs = some_docs(spark)
    made = fill_middle.transform(docs)
    assert made.columns == [*docs.columns, "fim"]
    found = made.withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(found) == docs.count()
    forms = Counter()
    for r in found:
        text = r["text"] or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        assert (r["fim"]["n"], r["fim"]["form"]) == (len(units), form)
        assert r["fim"]["output"] == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert r["back"] == text
        assert (r["fim"]["prefix"], r["fim"]["middle"], r["fim"]["suffix"]) == ((None,) * 3 if plain else (p, m, s))
        forms[form] += 1
    assert set(forms) == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0
    only = fill_middle.transform(docs, keep=["doc_id"], plain_percent=0, spm_percent=100)
    assert only.columns == ["doc_id", "fim"] and only.where("fim.form = 'psm'").count() == 0


def test_fill_middle_has_no_python(spark):
    plan = fill_middle.transform(some_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_collocations(rows, max_words, least, top, covers):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, max_words + 1):
                for k in range(len(w) - s + 1):
                    f[lang, tuple(w[k : k + s])] = f.get((lang, tuple(w[k : k + s])), 0) + 1
    good = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, p), a in good.items():
        longer = [v for (other, q), v in good.items() if other == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
        if any(100 * v >= covers * a for v in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    return {(lang, rank, p.decode(), -a, left, right, total, -score) for lang, x in out.items() for rank, (score, a, p, left, right, total) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize("bounds", [{}, {"shard_keys": 40, "part_keys": 16}, {"most_bits": 6, "part_keys": 64}, {"max_words": 4, "least": 3, "top": 7}, {"max_words": 4, "least": 3, "shard_keys": 200}])
def test_collocations(spark, monkeypatch, bounds):
    monkeypatch.setattr(collocations, "FEWEST_BITS", bounds.get("most_bits", 16))
    monkeypatch.setattr(collocations, "GROUP_ROWS", 500)
    docs = some_docs(spark)
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    found = collocations.collocations(docs, **bounds)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain_collocations(rows, bounds.get("max_words", 3), bounds.get("least", 10), bounds.get("top", 2000), 50)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected) > 3


def test_collocations_of_nothing(spark):
    docs = some_docs(spark)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text IS NULL OR text = ''")).count() == 0


def test_exact_products():
    assert "DECIMAL(38,0)" in collocations._CUT


def test_large_products(spark):
    # a * a passes 64 bits; a quotient in floating point would round up
    a, left = 10**14 + 1, 10**14 + 3
    row = spark.createDataFrame([(2, [a, left, a])], "size int, f array<long>").select(F.expr(collocations._CUT).alias("c")).first()["c"]
    assert row["score"] == 1_000_000 * a * a // (left * a) == 999_999


def test_perfect_hash():
    keys = RNG.integers(0, 1 << 63, (50_000, 2), dtype=np.uint64)
    parts = 7
    part = part_of(keys[:, 0], parts)
    known = PerfectHash({p: build(keys[part == p, 0], keys[part == p, 1]) for p in range(parts)}, parts)
    slots = known.slots(keys[:, 0], keys[:, 1])
    assert sorted(slots.tolist()) == list(range(50_000))
    others = RNG.integers(0, 1 << 63, (50_000, 2), dtype=np.uint64)
    assert (known.slots(others[:, 0], others[:, 1]) == -1).all()
    assert (known.slots(keys[:, 0], others[:, 1]) == -1).all()
    none = PerfectHash({}, 1)
    assert len(none) == 0 and (none.slots(keys[:, 0], keys[:, 1]) == -1).all()
    with pytest.raises(ValueError):
        build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def language_docs(spark):
    vocabulary = {"aa": [f"ka{k}lo" for k in range(80)], "bb": [f"mü{k}ße" for k in range(80)], "cc": [f"Žo{k}rů" for k in range(80)]}
    rows = [(k, " ".join(RNG.choice(vocabulary[lang], 40)), lang) for k in range(300) for lang in [["aa", "bb", "cc"][k % 3]]]
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "123 !?", "bb"), (403, " ".join(vocabulary["bb"] * 300), "bb"), (None, " ".join(vocabulary["aa"]), "aa"), (5, rows[5][1], "cc"), (404, "KA3LO KA5LO KA7LO KA9LO", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(2.0), "judged": F.lit(True), "held_out": F.lit("x")}).repartition(4)


def test_language_id(spark):
    docs = language_docs(spark)
    known = lang_id.learn(docs)
    assert list(known) == ["aa", "bb", "cc"]
    found = lang_id.predict(docs, known).collect()
    assert len(found) == docs.count()
    truth = {r["doc_id"]: r for r in docs.collect()}
    import zstandard

    for r in found:
        text = truth[r["doc_id"]]["text"]
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
        if r["doc_id"] in (400, 401, 402):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        assert r["lang_pred"] == (truth[r["doc_id"]]["lang"] or "aa") and r["accepted"]
        # the plain way: one call a chunk and language
        raw, sizes = text.lower().encode(), {}
        for lang, whole in known.items():
            cut = min(lang_id.LEAD, len(whole) // 2)
            coder = zstandard.ZstdCompressor(level=lang_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(whole[cut:], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            size = lambda x: len(coder.multi_compress_to_buffer([x])[0])  # noqa: B023, E731
            sizes[lang] = max(0, size(whole[:cut] + raw) - size(whole[:cut])) if len(raw) < lang_id.SHORT else sum(size(raw[k : k + lang_id.CHUNK]) for k in range(0, len(raw), lang_id.CHUNK))
        assert min(sizes, key=lambda x: (sizes[x], x)) == r["lang_pred"]


def test_language_id_margin_and_no_languages(spark):
    docs = language_docs(spark)
    same = {"aa": b"ka1lo ka2lo ka3lo " * 200, "ab": b"ka1lo ka2lo ka3lo " * 200}
    assert {(r["lang_pred"], r["accepted"]) for r in lang_id.predict(docs.where("doc_id < 300"), same).collect()} == {("aa", False)}
    assert {(r["lang_pred"], r["score"]) for r in lang_id.predict(docs, {}).collect()} == {("und", 0.0)}
    assert lang_id.learn(docs.limit(0)) == {} and lang_id.predict(docs.limit(0), same).count() == 0
    only = docs.where("lang = 'aa' AND doc_id IS NOT NULL")
    assert not any(held(r["doc_id"]) for r in only.where(~lang_id.held_out(F.col("doc_id"))).collect())


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lang_id.predict(docs, lang_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
