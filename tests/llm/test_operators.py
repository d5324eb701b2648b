"""The operators on small tables: brute force, nulls, empty tables, repeated rows, other columns."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.llm import op1_fingerprints, op2_mix, op4_secrets, op5_toxicity, op6_chat, op7_pieces, op8_media, op9_pii, op10_jaccard
from tesserae.llm.shingles import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, edited string, size long, comp long"
BASE = " ".join(f"word{i}" for i in range(120))
DOCS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("word60", "other"), "en", "b"), (4, "one two three", "en", None), (5, "ONE two  three", "de", None),
    (6, None, None, "b"), (7, "", "en", "b"), (8, "token=abcdef99 " + "x " * 40, "en", "a"), (8, "token=abcdef99 " + "x " * 40, "en", "a"), (9, "mail a.b@c.example.com or +1 (743) 555-3824", "en", "c"),
    (10, "long " * 60000, "en", "c"), (None, "no id", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1, 2) for r in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 1, 1), (99, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    docs.limit(0).write.parquet(f"{top}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/empty/labels.parquet")
    return top


def queries():
    from tesserae.llm.queries import QUERIES

    return [n for n in QUERIES if n != "op6_chat_format"]


@pytest.mark.parametrize("name", queries())
def test_edge_cases_and_empty_tables(spark, sf, name):
    from tesserae.llm.queries import QUERIES

    rows = QUERIES[name](spark, sf).collect()
    if name != "pipeline":
        assert len(rows) == len(DOCS)
    assert QUERIES[name](spark, f"{sf}/empty").collect() == []


def test_jaccard_components(docs):
    got = {r.doc_id: r.component_id for r in op10_jaccard.classes(docs).collect() if r.doc_id is not None}
    sets = {r[0]: set(shingles(r[1]).tolist()) for r in DOCS if r[0] is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == label


def test_fingerprints(spark, sf):
    rows = {r.doc_id: r for r in op1_fingerprints.op1_fingerprints(spark, sf).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[6].fingerprint == rows[7].fingerprint == ""
    assert rows[7].n_chars == 0 and rows[3].near_next > 0.8
    text = {r[0]: r[1] or "" for r in DOCS}
    import hashlib

    whole = text[3][: len(text[3]) - len(text[3]) // 2] + text[2][: len(text[3]) // 2]
    assert rows[3].edited_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_mix_reaches_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = op2_mix.op2_mix(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [r.target, 0, 0, 0])
        t[1], t[2], t[3] = t[1] + r.taken, t[2] + r.size, max(t[3], r.size)
    for target, taken, size, largest in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= largest
    assert rows == op2_mix.op2_mix(spark, sf).collect() or sorted(map(str, rows)) == sorted(map(str, op2_mix.op2_mix(spark, sf).collect()))


def test_redaction_keeps_rows(docs):
    out = op4_secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    assert out.where("text LIKE '%abcdef99%'").count() == 0


def test_surrogates(spark):
    texts = ["Call +1 (743) 555-3824 or 743-555-3824.", "A.B@x.example.com, a.b@x.example.com", "Mrs Smith, Mr. John Smith", "10.1.2.3.", "4539578763621486", None, "", "clean 12"]
    rows = [r.text for r in op9_pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert rows[5:] == [None, "", "clean 12"] and all(a != b for a, b in zip(rows[:5], texts[:5], strict=True))
    a, b = rows[1].split(", ")
    assert a == b
    assert rows[0].split("or ")[1][:3] == rows[0][9:12]
    assert rows[2].split()[1].strip(",") == rows[2].split()[-1]
    many = spark.range(3000).select((F.col("id") * 7 + 10**15).cast("string").alias("text"))
    assert op9_pii.pseudonymized(many).select("text").distinct().count() == 3000


def surrogates(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in op9_pii.pseudonymized(df).orderBy("doc_id").collect()]


def test_given_names_stay_distinct_and_keep_their_gender(spark):
    words = [f"{a}{b}{c}" for a in ("Jo", "Pe", "Ma", "Ka", "Lu") for b in ("han", "tri", "ren") for c in ("a", "o", "e", "us")]
    rows = surrogates(spark, [f"Mr {w} Smith" for w in words] + [f"Mrs {w} Smith" for w in words] + [f"Dr {w} Miller and Mr. {w} Miller or Prof. {w} Miller, Dr {w} Berg, Mrs {w} Berg" for w in words])
    n = len(words)
    assert len(set(rows[:n])) == n and len({x.split(" ", 1)[1] for x in rows[: 2 * n]}) == 2 * n
    assert len({x.split()[-1] for x in rows[: 2 * n]}) == 1
    for x in rows[2 * n :]:
        a, b, c, d, e = (y.split(" ", 1)[1] for y in x.replace(" and ", ", ").replace(" or ", ", ").split(", "))
        assert a == b == c and d == e and a.split()[0] != d.split()[0]
    assert all(x.split()[1].split("-")[0] in op9_pii.GIVEN["m", "latin"] for x in rows[:n])
    assert all(x.split()[1].split("-")[0] in op9_pii.GIVEN["f", "latin"] for x in rows[n : 2 * n])


def test_whole_names_are_replaced(spark):
    names = ["Mr. McDonald", "Mrs Smith-Jones", "Mr John O'Brien", "Dr John A. Smith", "Mr Peter van der Berg", "Prof. Dr. Eva Maria von Hohenfels", "Ms J. R. R. Tolkien", "Mr J.R. Ewing",
             "Mr Juan Carlos García López", "Dr John A Smith", "Herr D’Angelo", "Mr SMITH", "Mme d'Arcy", "Mr de la Cruz", "Г-жа Анна Петрова"]
    after = [" came.", ", who", "'s hat", "", " (x)", "\nNext Line"]
    rows = surrogates(spark, [f"Then {x}{y}" for x in names for y in after])
    for i, x in enumerate(rows):
        name, end = names[i // len(after)], after[i % len(after)]
        title = re.match(r"(?:(?:Mrs?|Ms|Dr|Prof|Herr|Mme|Г-жа)\.? )+", name)[0]
        assert x.startswith(f"Then {title}") and x.endswith(end), (name, x)
        new = x[len(f"Then {title}") : len(x) - len(end)]
        for word in name[len(title) :].replace("-", " ").replace("'", " ").replace("’", " ").split():
            assert word.strip(".").lower() not in new.lower().replace("-", " ").split(), (name, x)
        assert all(w[0].isupper() and w.replace("-", "").isalpha() for w in new.split()) and 1 <= len(new.split()) <= 2, (name, x)
    rows = surrogates(spark, ["Mr Smith and Mrs Jones met Mr. Smith's dog", "Mrs Smith I saw", "Mr Peter Berg, Mr Peter van der Berg"])
    a = rows[0].split()
    assert a[2:3] == ["and"] and a[8:] == ["dog"] and a[7] == f"{a[1]}'s" and rows[1].endswith(" I saw")
    b, c = rows[2].split(", ")
    assert b.split()[1] == c.split()[1] and b.split()[2] != c.split()[2]


def test_media_inspection(docs):
    got = op8_media.inspect(op8_media.media(docs)).collect()
    assert all(r.width % 8 == 0 and r.thumbnail_hash for r in got)


def test_encoded_ids(docs):
    got = op7_pieces.encode(docs, op7_pieces.model_bytes()).collect()
    assert {r.doc_id: r.decoded for r in got}[5] == "ONE two  three"


def test_toxicity_keeps_columns(docs):
    assert op5_toxicity.accepted(docs, None).schema == docs.schema


def test_chat_matches_sql(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow do I sort a table?\n\nThanks, Ann"), (1, 1, "assistant", "> How do I sort a table?\nUse orderBy."),
        (1, 2, "user", "On Monday Bob wrote:\n>> how do I SORT a table\n> Use orderBy.\nIt works.\n> unknown words"), (1, 3, "x", "> It works.\n\n\n\nGreat\n\n\n\nbye"),
        (2, 0, "user", None), (2, 1, None, "> How do I sort a table?"), (1, 3, "y", "dup > no"), (None, 1, "q", "> a"), (3, None, "q", "b"), (1, 2000, "z", ">It works\nlate"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(op6_chat.ORACLE)
    columns = [c[0] for c in got.description]
    mine = op6_chat.format_chat(df)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in mine.collect()))) == sorted(map(str, got.fetchall()))
    assert op6_chat.format_chat(df.limit(0)).collect() == []


def test_numbers_agree_however_they_are_written(spark):
    rows = surrogates(spark, ["call +49 30 123456 or +4930123456 or +49-30-123456", "+1 (743) 555-3824 or +17435553824", "4539 5787 6362 1486 or 4539578763621486", "+380 44 123 4567 or +380441234567"])
    for x, code in zip(rows, ("49", "1", "", "380"), strict=True):
        found = [re.sub(r"\D", "", y) for y in x.split(" or ")]
        assert len(set(found)) == 1 and found[0].startswith(code)
    assert rows[0] != "call +49 30 123456 or +4930123456 or +49-30-123456"


def test_names_keep_their_script(spark):
    rows = surrogates(spark, ["Mrs Παπά", "Г-жа Анна Петрова", "Mrs Smith", "Mr Νίκος Παππάς"])
    assert re.fullmatch(r"Mrs [Ͱ-Ͽἀ-῿]+", rows[0]) and re.fullmatch(r"Г-жа [Ѐ-ӿ-]+ [Ѐ-ӿ]+", rows[1])
    assert re.fullmatch(r"Mrs [A-Za-z]+", rows[2]) and re.fullmatch(r"Mr [Ͱ-Ͽἀ-῿-]+ [Ͱ-Ͽἀ-῿]+", rows[3])


def test_surrogates_of_given_documents(spark):
    """A plain walk over both texts: what stands around mentions stays, kinds stay, entities and surrogates match one to one."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    after = {r.doc_id: r.text for r in op9_pii.pseudonymized(docs).collect()}
    new_of, old_of, met = {}, {}, 0

    def entity(m):
        if "@" in m:
            return "email", m.lower()
        if regex.match(op9_pii._TITLES, m):
            return "name", regex.sub(f"^{op9_pii._TITLES}", "", m).lower()
        return "number", m.count("."), regex.sub(r"\D", "", m)

    for r in docs.collect():
        a, b = r.text or "", after[r.doc_id] or ""
        assert (r.text is None) == (after[r.doc_id] is None)
        assert regex.sub(op9_pii.ANY, "\0", a) == regex.sub(op9_pii.ANY, "\0", b)
        for m, n in zip(regex.findall(op9_pii.ANY, a), regex.findall(op9_pii.ANY, b), strict=True):
            x, y = entity(m), entity(n)
            assert x[0] == y[0] and m != n
            assert new_of.setdefault(x, y) == y and old_of.setdefault(y, x) == x, (m, n)
            met += 1
    assert met > 50
