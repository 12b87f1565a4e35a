"""Decontamination and license scan against brute force."""

import hashlib
import random
import re

from millrace.llm import decontaminate, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for k, x in items:
            v = words(x)
            for s in range(max(len(v) - n, 0) + 1 if v else 0):
                win = v[s : s + n]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        if k is not None:
                            got.add(k)
        out.append((i, len(w), len(hit), sorted(got)))
    return sorted(out, key=repr)


def run(docs, items, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, items, **kw).collect()), key=repr)


def items_frame(spark, items):
    return spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, w string")


def test_random_texts(spark, documents):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "x1"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + rnd.choice(["", ".", "!!"])
    items = [(k, text(rnd.choice([0, 1, 2, 5, 12, 14]))) for k in range(12)] + [(None, text(3)), (3, None), (3, text(11))]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)]
    docs += [(100, "pre " + items[11][1].upper() + " post"), (101, (items[11][1] + " ") * 3)]
    assert run(documents(docs), items_frame(spark, items)) == brute(docs, items)


def test_blocks_of_windows(spark, documents):
    """A benchmark beyond the broadcast bound takes more passes and loses nothing."""
    rnd = random.Random(2)
    items = [(k, " ".join(f"v{rnd.randrange(40)}" for _ in range(15))) for k in range(20)]
    docs = [(i, "a b " + items[i % 20][1] + " c") for i in range(30)] + [(99, "nothing here")]
    assert run(documents(docs), items_frame(spark, items), max_windows=7) == brute(docs, items)


def test_odd_rows(spark, documents, odd_rows):
    items = [(1, "beta gamma"), (2, "one"), (3, None), (4, ""), (1, "beta gamma"), (5, " ".join(f"word{i % 977}" for i in range(500, 530)))]
    assert run(documents(odd_rows), items_frame(spark, items)) == brute(odd_rows, items)


def test_empty_tables(spark, documents):
    none, item = documents([]), items_frame(spark, [(1, "a b")])
    assert run(none, item) == []
    assert run(documents([(1, "a b c")]), items_frame(spark, [])) == [(1, 3, 0, [])]


def test_clean_documents_keep_columns(spark, documents):
    d = documents([(1, "x a b y"), (1, "x a b y"), (2, "a c b"), (None, None)])
    out = decontaminate.clean_documents(d, items_frame(spark, [(1, "a b")]))
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id) == [(2, "a c b")] and out.count() == 2


def test_digest_query(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "b"), (9, "c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in decontaminate.op1_decontaminate(spark, str(tmp_path)).collect()}
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and got[1].contaminated and got[1].n_items == 2
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].contaminated


# license scan


def brute_license(docs, phrases=license_scan.PHRASES, templates=license_scan.TEMPLATES):
    out = []
    for i, t in docs:
        w = words(t)
        places = sorted((p, label) for ph, label in phrases.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split())
        blocks = []
        for b in range(max(-(-(len(w) - license_scan.BLOCK) // license_scan.STRIDE), 0) + 1 if w else 0):
            have = set(w[b * license_scan.STRIDE : b * license_scan.STRIDE + license_scan.BLOCK])
            for label, text in templates:
                ts = list(dict.fromkeys(text.split()))
                if len(have & set(ts)) >= license_scan.THRESHOLD * len(ts) - 1e-9:
                    blocks.append((b, label, round(len(have & set(ts)) / len(ts), 9)))
        out.append((i, len(w), places, sorted(blocks)))
    return sorted(out, key=repr)


def run_license(docs):
    return sorted(((r.doc_id, r.n_words, [(p.start, p.label) for p in r.places], sorted((b.block, b.label, round(b.containment, 9)) for b in r.blocks)) for r in license_scan.license_places(docs).collect()), key=repr)


def test_licenses(spark, documents, odd_rows):
    rnd = random.Random(3)
    fill = lambda n: " ".join(rnd.choice(["the", "of", "software", "license", "this", "is", "a", "to"]) for _ in range(n))
    docs = [(i, fill(rnd.randint(0, 200))) for i in range(20)]
    for i, (_, t) in enumerate(license_scan.TEMPLATES):
        docs += [(100 + i, fill(rnd.randint(0, 150)) + " " + t + " " + fill(rnd.randint(0, 90))), (200 + i, " ".join(x for x in t.split() if rnd.random() > 0.12))]
    docs += [(300, "Released under the MIT License. MIT license, mit-license"), (301, "GNU General Public License (Apache License)")]
    docs += [(i, t) for i, t in odd_rows if not t or len(t) < 1000]
    assert run_license(documents(docs)) == brute_license(docs)


def test_license_long_text_and_empty_table(spark, documents):
    docs = [(1, "pad " * 50_000 + "apache license " + "pad " * 10)]
    assert run_license(documents(docs)) == brute_license(docs)
    assert run_license(documents([])) == []
