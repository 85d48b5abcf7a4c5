"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_wrappers, jaccard, kernels, language, licences, line_templates, mixing, neighbours, substring, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["The", "THE", "naïve"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(45)
    texts = [None, "", " \t\n", "one", "a b", "Ünï cödé\x0bx", text(4000)]
    while len(texts) < n:
        t = text(rng.randint(1, 200))
        texts += [t, t, t.replace(" ", "\n", 3), t + " extra", passage if rng.random() < 0.3 else text(5) + " " + passage + " " + text(9)]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("n_words", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("token", F.lit(None)).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_kernel():
    texts = [t for _, t, *_ in corpus()]
    w = kernels.words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [x.decode() for x in w.text(w.bounds[i], w.bounds[i + 1])] == WORD.findall(t or "")
    by_word = {}
    for x, h in zip(w.text(0, len(w.doc)), w.hash.tolist(), strict=True):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_substring(docs, nothing):
    rows, df = docs
    seen, want = set(), {}
    for i, t, *_ in rows:
        seq = WORD.findall(t or "")
        gone = [False] * len(seq)
        for s in range(len(seq) - 19):
            k = tuple(seq[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(seq), sum(gone), " ".join(x for x, g in zip(seq, gone, strict=True) if not g))
    for batches in (1, 2, 7):  # 7 batches: runs are merged on the way
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(df, batches=batches).collect()}
        assert got == want
    assert substring.dedup_substrings(nothing).count() == 0


def sets(t, k):
    seq = WORD.findall((t or "").translate(LOWER))
    return {tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)} or ({tuple(seq)} if seq else set())


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(docs, nothing, k, num):
    rows, df = docs
    s = {i: sets(t, k) for i, t, *_ in rows}
    label = {i: i for i in s}
    changed = True
    while changed:
        changed = False
        for a in s:
            for b in s:
                if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= num * len(s[a] | s[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, words=k, num=num, den=100).collect()}
    assert got == {i: (len(s[i]), label[i]) for i in s}
    assert jaccard.jaccard_groups(nothing).count() == 0


def test_decontaminate(spark, docs, nothing):
    rows, df = docs
    items = [(1, " ".join((rows[20][1] or "").split()[:14])), (2, "one"), (3, None), (10, (rows[20][1] or "").upper()), (None, "a b"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pat.findall((t or "").translate(LOWER))
    want = {}
    for i, t, *_ in rows:
        seq, hit, ids = words(t), set(), set()
        for item, x in items:
            p = words(x)
            if item is None or not p:
                continue
            m = min(10, len(p))
            grams = {tuple(p[j : j + m]) for j in range(len(p) - m + 1)}
            for j in range(len(seq) - m + 1):
                if tuple(seq[j : j + m]) in grams:
                    hit |= set(range(j, j + m))
                    ids.add(str(item))
        want[i] = (len(seq), len(hit), sorted(ids), bool(hit))
    found = decontaminate.decontaminate(df, bench)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()} == want
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert not found.sparkSession.createDataFrame([(1, "x")], "doc_id long, text string").transform(lambda d: decontaminate.decontaminate(d, bench.limit(0))).first().contaminated


def test_decontaminate_in_groups(spark, docs, monkeypatch):
    rows, df = docs
    bench = spark.createDataFrame([(i, t) for i, t, *_ in rows[20:26]], "item_id long, text string")
    one = {r.doc_id: (r.n_hit, r["items"], r.hit_spans) for r in decontaminate.decontaminate(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 500)
    assert {r.doc_id: (r.n_hit, r["items"], r.hit_spans) for r in decontaminate.decontaminate(df, bench).collect()} == one


def test_mixing(docs, nothing):
    rows, df = docs
    got = mixing.mix(df).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    by = {}
    for r in got:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        by.setdefault(r.source, []).append(r)
    total = sum(size.values())
    left, open_, want = 1.5 * total, sorted(by, key=lambda s: (s is None, s or "")), {}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(open_)}
    while True:  # share, cut, share again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * by[s][0].source_size]
        if not full:
            want |= share
            break
        for s in full:
            want[s] = 2.0 * by[s][0].source_size
            left -= want[s]
            open_.remove(s)
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r["size"] for r in rs) + 1
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0


def test_mixing_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(2, "d", "x"), (None, "e", None)], "doc_id long, text string, source string")
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in mixing.mix(df).collect())


def test_token_files(spark, docs, nothing, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, df = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = [(900, "x <|endoftext|> y"), (901, "a  b   c \n\n d"), (902, "it's  'll"), (903, " lead"), (904, "tail "), (905, "a b c  d")]
    df = df.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    out = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(df, out, path, files=4)
    start = 0
    got = {r.doc_id: r for r in token_files.read_documents(spark, out).collect()}
    for i, t in sorted([(r[0], r[1]) for r in rows] + odd):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    assert manifest["tokens"] == start and len(got) == len(rows) + len(odd)
    tokens, offsets, ids, null = token_files.open_part(out, manifest, manifest["parts"][0])
    assert isinstance(tokens, np.memmap) and tokens.dtype == np.uint16 and offsets[-1] == len(tokens) and len(ids) == manifest["parts"][0]["docs"]
    assert token_files.tokenize_documents(nothing).count() == 0


def test_language(spark, nothing):
    rng = random.Random(3)
    words = {"aa": ["the", "and", "thing", "other"], "bb": ["und", "nicht", "schön", "größe"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x) for i, x in enumerate(["aa", "bb"] * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(1, "the other", "aa"), (2, "schön nicht", "bb"), (3, None, "und"), (4, "123 -- ...", "und"), (5, "", "und"), (6, "nothing andthe", "aa"), (7, "GRÖSSE schönen " * 4000, "bb")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame([(i, t, "zz", "s") for i, t, _ in tests], "doc_id long, text string, lang_pred string, score string"), model).collect()}
    for i, _, want in tests:
        assert got[i].lang_pred == want and 0 <= got[i].score <= 1
    empty = language.train(nothing)
    assert language.identify(nothing.union(spark.createDataFrame([(1, "x", None, None)], SCHEMA)), empty).first().lang_pred == "und"


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:140] = v[100]  # more equal vectors than a list holds
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = {}
    for r in neighbours.Neighbours(df).search(F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 700, 20):
        s = np.array([round(x, 12) for x in u @ u[q]])
        s[q] = -9
        want = np.lexsort((np.arange(700), -s))[:5].tolist()
        mine = [x for _, x, _ in sorted(got[q])]
        hit += len(set(want) & set(mine))
    assert hit >= 0.95 * 35 * 5 and set(got) == set(range(0, 700, 20))
    assert sorted(x for _, x, _ in got[100]) == [101, 102, 103, 104, 105]
    few = neighbours.Neighbours(df.where("vec_id < 3")).search(F.lit(True)).collect()
    assert len(few) == 6
    assert neighbours.Neighbours(df.limit(0)).search(F.lit(True)).count() == 0


PAGE = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href='/x'>menu</a></nav><div class='cookie-notice'>accept</div>{main}<div id=comments><p>first!</p></div><footer>foot</footer></body></html>"


def test_html(spark):
    article = "<article><h1>Title &amp; more</h1><p>One <b>bold</b>\n text<p>Two&nbsp;x<br>three<aside>ad</aside><form>f</form></article>"
    plain = "<div class=content><p>Alpha beta gamma delta</p><p>Epsilon zeta</p></div>"
    rows = [(1, "http://a.x/1", PAGE.format(main=article)), (2, "http://a.x/2", PAGE.format(main=article.replace("One", "Uno"))), (3, "http://b.x/1", PAGE.format(main=plain)), (4, "http://b.x/2", None), (5, None, "just text &lt;"), (6, "http://a.x/3", ""), (6, "http://a.x/3", "")]
    got = {}
    for r in html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id] = r.text
    assert got[1] == "Title & more\nOne bold text\nTwo x\nthree"
    assert got[2].startswith("Title & more\nUno bold text")
    assert got[3] == "Alpha beta gamma delta\nEpsilon zeta"
    assert got[4] == got[6] == "" and got[5] == "just text <"
    assert html_wrappers.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_alignment():
    parse = lambda s: html_wrappers.fold(html_wrappers.parse(s))
    a = parse("<ul><li>a<li>b</ul><p>x</p>")
    b = parse("<ul><li>a</ul><h2>t</h2><p>y</p><p>z</p>")
    assert html_wrappers.expression(html_wrappers.align(a, b)) == "<#page>(<ul>(<li>(#text)+) <h2>(#text)? <p>(#text)+)"


def test_licences(spark):
    rng = random.Random(5)
    ordinary = [" ".join(rng.choice(["sun", "work", "version", "public", "moon", "the", "terms", "general", "copy"]) for _ in range(12)) for _ in range(400)]
    model = licences.train(ordinary, copies=25)
    assert model.accuracy > 0.95
    rows = [(1, "intro line here\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "the general public version of the work\nunder terms"), (5, "word " * 5000 + "\nLicensed under the Apache License, Version 2.0."), (6, "This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0.")]
    got = [(r.doc_id, r.n_paragraphs, r.families) for r in licences.scan_licences(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, families string"), model).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, ["MIT"]), (2, 0, []), (3, 0, []), (4, 2, []), (5, 2, ["Apache-2.0"]), (6, 1, ["GPL-3.0"]), (6, 1, ["CC-BY-NC-4.0"])], key=str)
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_line_templates(spark, nothing):
    rows = [(i, f"own words of text number{chr(97 + i)} are here {'x' * i} and there\nPage {i} of 99 pages\nshort line") for i in range(8)] + [(20, None), (21, ""), (None, "Page 7 of 9 pages")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0][:2] == (3, 0) and all(got[i][1] >= 1 and "Page" not in got[i][2] and "short line" in got[i][2] for i in range(1, 8))
    assert got[20] == (0, 0, "") and got[21] == (1, 0, "") and got[None] == (1, 1, "")
    assert line_templates.dedup_lines(nothing).count() == 0
    x = np.array([[1, 2, 3, 4], [1, 2, 3, 9], [7, 7, 7, 7]], np.uint16)
    assert line_templates.cluster(x, 0.7).tolist() == [0, 0, 1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rows = corpus(2, 40)
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    leak = rows[30][1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in c.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, f in c.STAGES:
        out = f(spark, docs, str(tmp_path))
        if k != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = [r.doc_id for r in docs.collect()]
    letters = {i for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    assert set(kept["language_id"]) == letters
    assert len(set(kept["jaccard_join"])) == len(kept["jaccard_join"]) and 30 not in kept["decontamination"]
    for a in kept["jaccard_join"]:  # nothing linked is left
        for b in kept["jaccard_join"]:
            x, y = sets(rows[a][1], 5), sets(rows[b][1], 5)
            assert a == b or 100 * len(x & y) < 80 * len(x | y)
    assert sorted(kept["mixing"]) == sorted(kept["token_files"])
    assert hashlib.sha256(str(sorted(r.doc_id for r in c.run(spark, str(tmp_path)).collect())).encode()).hexdigest() == hashlib.sha256(str(sorted(kept["token_files"])).encode()).hexdigest()


def test_line_templates_of_a_large_leaf(spark):
    # 4,200 fillers in tokens 4 and 5: no size cuts the template apart
    rows = [(i, f"Article written by name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of the Daily Times") for i in range(4200)]
    out = line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in out.where("n_dropped = 0").select("doc_id", "n_lines").collect()] == [(0, 1)]


def test_line_cluster_finds_what_a_full_comparison_finds():
    rng = np.random.default_rng(3)
    for n, kinds in ((5, 3), (9, 4), (12, 60)):
        lines = rng.integers(0, kinds, (400, n)).astype(np.uint16)
        templates, want = [], []
        for x in lines:
            agree = [int((t == x).sum()) for t in templates]
            if agree and max(agree) >= 0.7 * n:
                want.append(agree.index(max(agree)))
                templates[want[-1]][templates[want[-1]] != x] = 0
            else:
                want.append(len(templates))
                templates.append(x.copy())
        assert line_templates.cluster(lines, 0.7).tolist() == want


def test_line_templates_count_documents(spark):
    poem = "\n".join(f"The cat sat on {x}" for x in ("mat", "rug", "bed", "sill", "stool", "chair"))
    rows = [(1, poem), (2, "other text of its own here"), *((3, "The dog ran to " + x) for x in ("me", "you", "us", "them", "her"))]
    rows += [(10 + i, f"We like to eat {x}") for i, x in enumerate(("figs", "plums", "pears", "grapes", "dates"))]
    out = line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_dropped").collect()
    # one document, or rows of one id, are one document however many lines of a template they have
    assert sorted(map(tuple, out)) == sorted([(1, 0), (2, 0), *[(3, 0)] * 5, (10, 0), *((10 + i, 1) for i in range(1, 5))])


def test_substring_tells_windows_of_one_anchor_apart(spark):
    # both windows have the anchor "h12588x0 ... h12588x9" and agree in the upper 32 bits of their hashes
    phrase = " ".join(f"h12588x{j}" for j in range(10))
    rows = [(1, f"{phrase} a b c d e f g h i n1582"), (2, f"{phrase} a b c d e f g h i n181553"), (3, f"{phrase} a b c d e f g h i n1582")]
    out = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(1, 0), (2, 0), (3, 20)]


def test_wrapped_licences(spark):
    import textwrap

    rng = random.Random(5)
    model = licences.train([" ".join(rng.choice(["sun", "work", "version", "public", "moon", "the", "terms", "general", "copy"]) for _ in range(12)) for _ in range(400)], copies=25)
    notices = {f: max(licences.NOTICES[f], key=len) for f in ("BSD", "GPL-3.0", "ISC", "MIT")}
    rows, want = [], []
    for f, notice in notices.items():
        for width in (30, 70, 80):
            rows.append((len(rows), "moon and sun\n\n# " + "\n# ".join(textwrap.wrap(notice, width)) + "\n\nsun and moon"))
            want.append((len(rows) - 1, [f], 1))
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert sorted((r.doc_id, r.families, r.n_licence) for r in got.collect()) == want


def brute_windows(rows):
    """Words kept of (id, text) rows in order; rows equal in both are one document."""
    seen, out = {}, {}
    for n, row in enumerate(rows):
        if row in out:
            continue
        seq = WORD.findall(row[1] or "")
        gone = [False] * len(seq)
        for s in range(len(seq) - 19):
            if seen.setdefault(tuple(seq[s : s + 20]), (n, s)) != (n, s):
                gone[s : s + 20] = [True] * 20
        out[row] = (len(seq), sum(gone), " ".join(x for x, g in zip(seq, gone, strict=True) if not g))
    return out


def test_substring_repeated_and_null_ids(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, b, c, d = text(40), text(40), text(60), text(40)
    rows = [(1, a), (5, b), (5, a + " " + c), (5, b), (7, None), (9, c), (None, d), (None, text(50)), (None, d + " end"), ((1 << 63) - 1, d)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    ordered = []  # by id, then by a hash of the text, nulls last
    for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).collect():
        both = [x for x in rows if x[0] == r.doc_id]
        many = r.doc_id is not None and len(set(both)) > 1
        h = r.h | 1 if r.doc_id is None else r.h & -2 if many else 0
        ordered.append((((1 << 63) - 1 if r.doc_id is None else r.doc_id, h), (r.doc_id, r.text)))
    want = brute_windows([x for _, x in sorted(ordered, key=lambda x: x[0])])
    assert got == sorted((str(r[0]), *want[r]) for r in rows)
    assert sum(r[2] == 0 for r in got if r[0] == "5") == 2  # what repeats nothing loses nothing, whatever its id


def test_substring_index_goes_on_in_a_later_job(spark, tmp_path):
    from tessera.llm.common import Scratch, with_sub

    rng = random.Random(9)
    passages = [" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(5)]
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(25)) + " " + rng.choice(passages)) for i in range(24)]
    want, got, done = brute_windows(rows), {}, []
    for part in range(6):
        index = substring.FingerprintIndex(spark, 4, fanout=2, path=f"file://{tmp_path}/runs")  # as a new job does
        assert len(index.runs) <= 2
        done += rows[4 * part : 4 * part + 4]
        texts = with_sub(spark.createDataFrame(done, "id long, text string"), Scratch(spark, "test"))
        for r in index.add(texts.where(F.col("id") >= 4 * part), texts).collect():
            got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert {i: len(got.get(i, ())) for i, _ in rows} == {r[0]: want[r][1] for r in rows}


def test_line_templates_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    kinds = [[word() for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.6:
                line = list(rng.choice(kinds[: 2 + i // 4]))
                line[5] = rng.choice([word(), f"{rng.randint(0, 99)}"])
                lines.append(" ".join(line))
            else:
                lines.append(" ".join(word() for _ in range(rng.randint(1, 9))))
        rows.append((i if i % 9 else None, "\n".join(lines)))
    rows += [(3, rows[3][1]), (4, "same id, other text here"), (None, None)]
    docs, where = {}, {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            for k, kind in enumerate(kinds):
                x = line.split(" ")
                if x[:5] + x[6:] == kind[:5] + kind[6:]:
                    docs.setdefault(k, set()).add((i, t if i is None else None))
                    where.setdefault(k, []).append((order((i, t)), t, n))
    got = {}
    for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.n_lines, r.n_dropped, r.kept_text), 0)
    drop, first = {}, {}
    for k, at in where.items():
        if len(docs[k]) >= 5:
            first[k] = min(a[0] for a in at)
            for o, t, n in at:
                drop.setdefault((o, t), {})[n] = k
    for i, t in set(rows):
        if t is None:
            continue
        lines, gone = t.split("\n"), drop.get((order((i, t)), t), {})
        keep = set()
        for k in set(gone.values()):
            if first[k] == order((i, t)):
                keep.add(min(n for n, x in gone.items() if x == k))
        kept = [x for n, x in enumerate(lines) if n not in gone or n in keep]
        if i is not None or not keep:
            assert (i, len(lines), len(lines) - len(kept), "\n".join(kept)) in got, (i, t)
    assert len(drop) > 5


def test_mixing_tells_texts_of_one_id_apart(spark):
    rows = [(1, "a b c", "x"), (1, "d e", "y"), (1, "d e", "y"), (None, "f g h i", "x"), (None, "j", "y"), (2, None, "x"), (3, "k l", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("size", F.lit(0))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    from collections import Counter

    keyed = df.withColumn("doc_id", F.xxhash64("doc_id", "text"))
    want = Counter()
    taken = {(r.doc_id, r.source): 0 for r in keyed.collect()}
    for r in mixing.mix(keyed).collect():
        taken[r.doc_id, r.source] += r.copies
    for r in mixed.withColumn("key", F.xxhash64("doc_id", "text")).collect():
        want[r.key, r.source] += 1
        assert (r.doc_id, r.text, r.source) in rows
    for source in ("x", "y", None):  # each source's words come near its target
        assert abs(sum(len((r.text or "").split()) for r in mixed.collect() if r.source == source) - next(r.target for r in mixing.mix(df).collect() if r.source == source)) <= 4


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    text = lambda s, n=30: " ".join(f"{s}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    rows = [(None, text("aa"), "en", "s"), (None, text("bb"), "en", None), (None, text("bb"), "en", None), (4, text("cc"), "en", "s"), (4, text("dd"), "en", "s"), (5, text("cc") + " more", "en", "s"), (6, None, "en", "s"), (7, "", None, None), (8, "!", None, "s"), (9, text("ee", 3000), None, "t")]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(1, text("dd"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ("id", "n", "label", "token", "key", "copies", "score", "lang_pred", "contaminated", "n_words", "least", "sub", "_tessera_key")
    df = spark.createDataFrame(rows, schema).withColumns({x: F.lit("clash") for x in extra if x != "_tessera_key"})
    stages = dict(c.STAGES)
    kept = stages["jaccard_join"](spark, df, str(tmp_path))
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    # null ids stay, copies go, texts of one id are told apart; of the two near copies of "cc" one stays
    near = [x for x in got if x[1].startswith("cc")]
    assert len(near) == 1 and sorted(x for x in got if x not in near) == sorted([("None", text("aa")), ("None", text("bb")), ("4", text("dd")), ("6", ""), ("7", ""), ("8", "!"), ("9", text("ee", 3000))])
    clean = stages["decontamination"](spark, df, str(tmp_path))
    assert clean.columns == df.columns and sorted(str(r.text) for r in clean.collect()) == sorted(str(r[1]) for r in rows if r[1] != text("dd"))
    named = stages["language_id"](spark, df, str(tmp_path))
    assert named.columns == df.columns and {r.text for r in named.collect()} <= {r[1] for r in rows if r[1] and r[1] != "!"}
    assert stages["mixing"](spark, df, str(tmp_path)).columns == df.columns
    tokens = stages["token_files"](spark, df, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in tokens) == sorted(str(r[0]) for r in rows)
    for name, stage in c.STAGES:
        out = stage(spark, df.limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "token_files" or out.columns == df.columns)


def test_odd_texts_are_found():
    import pyarrow as pa

    texts = ["a b\nc", "", " a", "a ", "a  b", "a\tb", "a\u00a0b", "a\u2003b", "a\u3000b", "\u2019x y", "\u00c2x", "a\n\nb", "x\n", "\u1680", "é è"]
    want = [bool(t) and bool(re.search(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]\Z", t)) for t in texts]
    assert token_files.odd_texts(*kernels.text_buffer(pa.array(texts))).tolist() == want


def test_encoder_forgets_what_is_rare(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "REMEMBER", 60)
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok, rng = token_files.Encoder(path), Tokenizer.from_file(path), random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "of", f"x{rng.randint(0, 999)}", "don't,", "naïve"]) for _ in range(20)) for _ in range(3)] + [None, "", "a\nb c\nd", "a  b"]
        ids, lengths = enc.encode(pa.array(texts), 2)
        want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and lengths.tolist() == [len(w) for w in want]


def pages_of(spark, host, bodies):
    rows = [(i, f"https://{host}/{i}", f"<html><head><title>T</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("paths", F.lit("clash")))
    return {r.page_id: r.text for r in found.collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_html_of_a_host_without_marks(spark):
    # no article, no class: what all pages share is the host's, what differs is the page's
    rng = random.Random(1)
    mine = [[words(rng, 20) for _ in range(rng.randint(2, 4))] for _ in range(6)]
    page = "<div>Cookie text that every page has</div><div><div>All about us and nothing else</div><h2>Summary</h2>{}<div>Send us a letter</div></div><div><a href=/a>one</a><a href=/b>two</a></div>"
    got = pages_of(spark, "plain.x", [page.format("".join(f"<p>{x}</p>" for x in m)) for m in mine])
    assert got == {i: "\n".join(["Summary", *m]) for i, m in enumerate(mine)}


def test_html_class_words_do_not_hide_content(spark):
    rng = random.Random(2)
    a, b, c = ([words(rng, 30) for _ in range(5)] for _ in range(3))
    got = pages_of(spark, "side.x", [f"<div class='side-story'><p>{x}</p></div>" for x in a])
    assert got == dict(enumerate(a))
    page = "<header><a href=/>home</a></header><article><header><h1>{0}</h1></header><p>{1}</p><div class='related-work'><p>{2}</p></div><div class=related><a href=/1>{0}</a> <a href=/2>more</a></div><aside>ad</aside></article>"
    got = pages_of(spark, "art.x", [page.format(f"Title {i}", x, y) for i, (x, y) in enumerate(zip(b, c, strict=True))])
    assert got == {i: f"Title {i}\n{x}\n{y}" for i, (x, y) in enumerate(zip(b, c, strict=True))}


def test_html_copies_keep_their_text(spark):
    assert pages_of(spark, "copy.x", ["<div><p>one and the same</p><p>on all pages</p></div>"] * 8) == dict.fromkeys(range(8), "one and the same\non all pages")


def test_html_odd_pages_in_linear_time():
    import time

    for odd, want in (("<div>" * 50_000 + "x" + "</div>" * 50_000, "x"), ("y<a " * 1_000_000, None), ('<a ">"' * 100_000 + '"', None), ("<p>x" * 50_000, "x\n" * 49_999 + "x"), ("<x>" * 50_000 + "<li>" * 50_000, ""), ("<h2>a</h2><p>b</p>" * 10_000, "a\nb\n" * 9_999 + "a\nb"), ("</x>" * 100_000 + "z", "z"), ("v<!-- " * 100_000, "v")):
        began = time.process_time()
        out = html_wrappers.extract(odd, html_wrappers.rules(html_wrappers.fold(html_wrappers.parse(odd))))
        assert time.process_time() - began < 20 and (want is None or out == want), odd[:20]


def test_html_precision_and_recall_of_blocks(spark):
    rng = random.Random(3)
    layouts = [
        "<nav><a href=/>a</a></nav><article><h1>{t}</h1>{m}<div class='share-bar'>tweet</div></article><div id=comments><p>{x}</p></div><footer>f</footer>",
        "<div class='top menu'><a href=/>a</a></div><main><section>{m}</section><aside>{x}</aside></main><div class='cookie-consent'>ok</div>",
        "<table><tr><td><a href=/>a</a> <a href=/b>b</a></td><td><h1>{t}</h1>{m}</td></tr></table><p>Copyright of the host</p>",
        "<div id=page><div class=content><h2>{t}</h2>{m}</div><div class=sidebar><ul><li>{x}</li></ul></div></div>",
    ]
    hit = said = there = 0
    for k, layout in enumerate(layouts):
        truth, bodies = [], []
        for i in range(12):
            main = [words(rng, rng.randint(8, 25)) for _ in range(rng.randint(2, 6))]
            title = f"Title {words(rng, 3)}"
            bodies.append(layout.format(t=title, m="".join(f"<p>{x}</p>" for x in main), x=words(rng, 5)))
            truth.append(({title} if "{t}" in layout else set()) | set(main))
        for i, text in pages_of(spark, f"l{k}.x", bodies).items():
            got = set(text.split("\n"))
            hit, said, there = hit + len(got & truth[i]), said + len(got), there + len(truth[i])
    assert hit / said > 0.97 and hit / there > 0.97, (hit / said, hit / there)


def test_neighbours_of_many_cells_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6000, 16)) + 1.5 * rng.normal(size=(12, 16))[rng.integers(0, 12, 6000)]
    v[200:212] = v[200] * np.arange(1, 13)[:, None]  # multiples: other bytes, equal cosine
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "CELL", 100)
    index = neighbours.Neighbours(df)
    assert index.rounds >= 2  # cells of 100 are only a begin
    u = v / np.linalg.norm(v, axis=1, keepdims=True)

    def found(**options):
        got = {}
        for r in index.search(F.col("id") % 50 == 0, **options).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        return got

    one = found()
    hit = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {x for x, _ in one[q].values()}) if q != 200 else 5
        assert all(abs(s[x] - score) < 1e-12 for x, score in one[q].values())
    assert hit >= 0.95 * 120 * 5
    assert {x for x, _ in one[200].values()} <= set(range(201, 212))
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 16 * 4 * 30)  # 30 queries a block
    assert found() == one
    many = found(k=30)  # more than any list or sample holds
    assert all(len(x) == 30 for x in many.values()) and all([x[i][0] for i in range(1, 6)] == [one[q][i][0] for i in range(1, 6)] or q == 200 for q, x in many.items())


def test_jaccard_groups_do_not_hang_on_the_token_order(docs, monkeypatch):
    _, df = docs
    want = sorted(map(tuple, jaccard.jaccard_groups(df).collect()), key=str)
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "TABLE", 3)
    assert sorted(map(tuple, jaccard.jaccard_groups(df).collect()), key=str) == want


def test_jaccard_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(7, t), (7, t), (3, t + " more"), (None, t), (None, None), (9, None), (5, "a b"), (4, "A  B"), (6, "")]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("7", 3), ("7", 3), ("3", 3), ("None", None), ("None", None), ("9", 9), ("5", 4), ("4", 4), ("6", 6)])


def test_decontaminate_repeated_rows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "x " + item + " y"), (1, "x " + item + " y"), (None, item), (2, None)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("i", item), ("i", item), ("j", item)], "item_id string, text string"))
    assert sorted((str(r.doc_id), r.n_hit, r["items"]) for r in got.collect()) == [("1", 12, ["i", "j"]), ("1", 12, ["i", "j"]), ("2", 0, []), ("None", 12, ["i", "j"])]


def test_token_files_null_and_repeated_ids(spark, tmp_path):
    import public_tokenizers

    least = -(1 << 63)
    rows = [(None, "z"), (2, "b b"), (2, "a"), (least, "a"), (1, None), (None, None)]
    out = f"file://{tmp_path}/n"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out, public_tokenizers.path("byte_bpe_50k.json"), files=3)
    got = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [least, 1, 2, 2, None, None] and sorted(r.n_tokens for r in got if r.doc_id is None)[0] == 1
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(6)]


def test_language_ties_and_repeats(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("same words", "bb"), ("same words", "aa"), (None, "aa"), ("x", None)])]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identify(spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (2, "qqq")], "doc_id long, text string"), model)
    assert {r.lang_pred for r in got.collect()} == {"aa"} and got.count() == 4  # ties go to the first by code point


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_languages(spark):
    d = "/root/testdata/sf0.01"
    found = language.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    right, n = found.where("held_out and lang is not null and lang_pred != 'und'").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 250 and right / n > 0.98, (right, n)
