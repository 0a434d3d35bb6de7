"""The dictionary matcher against hand-made cases and a brute-force one."""

import random

import pytest

from vacantia.operators import skills

WORD = set("abcdefghijklmnopqrstuvwxyz0123456789_")


def brute_force(text, keywords):
    """Leftmost, longest, not overlapping, by trying every start."""
    text, found, i = text.lower(), [], 0
    while i < len(text):
        best = None
        if i == 0 or text[i - 1] not in WORD:
            for k in keywords:
                end = i + len(k)
                if text.startswith(k, i) and (end == len(text) or text[end] not in WORD):
                    best = k if best is None or len(k) > len(best) else best
        if best:
            found.append(best)
            i += len(best) + 1
        else:
            i += 1
    return sorted(set(found))


def matched(spark, texts, keywords, limit=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, description string")
    entries = spark.createDataFrame([("k", k, k.lower(), i) for i, k in enumerate(keywords)],
                                    "kind string, skill string, variant string, position int")
    more = {} if limit is None else {"limit": limit}
    out = skills.with_skills(docs, "doc_id", "description", skills.vocabulary(entries), {"k": "found"}, **more)
    rows = {r["doc_id"]: r["found"] for r in out.collect()}
    return [rows[i] for i in range(len(texts))]


CASES = [
    ("C++, PL/SQL für R", ["c++", "pl/sql", "sql", "r", "f"], ["c++", "f", "pl/sql", "r"]),
    ("c++x c+++", ["c++"], ["c++"]),
    ("asp.net .net", [".net"], [".net"]),
    ("asp.net", [".net"], []),
    ("machine machine learning", ["machine", "machine learning"], ["machine", "machine learning"]),
    ("of the", ["of", "of the", "the"], ["of the"]),
    ("python3", ["python"], []),
    ("Für", ["für", "f", "r"], ["für"]),
    ("", ["a"], []),
    (None, ["a"], []),
    ("a b c", ["a b", "b c", "c"], ["a b", "c"]),
    ("x_y x y", ["x", "y"], ["x", "y"]),
]


@pytest.mark.parametrize("text, keywords, wanted", CASES)
def test_cases(spark, text, keywords, wanted):
    assert matched(spark, [text], keywords) == [wanted]
    assert text is None or brute_force(text, keywords) == wanted


@pytest.mark.parametrize("limit", [None, 0])
def test_random_texts(spark, limit):
    """Both the broadcast plan and the one for dictionaries too large to broadcast."""
    rng = random.Random(7)
    letters = "ab1_ +. ü\n"
    for _ in range(3):
        keywords = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))).strip() for _ in range(25)} - {""})
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
        assert matched(spark, texts, keywords, limit) == [brute_force(t, keywords) for t in texts]


def test_last_of_equal_names_wins(spark):
    taxonomy = spark.createDataFrame([(0, "Excel", "Common Skill"), (1, "EXCEL", "Common Skill"), (2, "Excel", "Common Skill"),
                                      (3, " Other ", "Unlisted")], "position int, name string, type_name string")
    docs = spark.createDataFrame([(1, "excel other", "IT"), (2, "x", "HR")], "doc_id int, description string, domain_label string")
    rows = skills.extract_skills(docs, taxonomy, "IT").collect()
    assert [(r["doc_id"], r["hard_skills"], r["soft_skills"]) for r in rows] == [(1, [], ["EXCEL"])]


def test_synonyms(spark):
    docs = spark.createDataFrame([(1, "Python3, PL/SQL; K8s"), (2, "sqlx")], "doc_id int, description string")
    rows = {r["doc_id"]: r["extracted_skills"] for r in skills.extract_synonyms(docs).collect()}
    assert rows == {1: ["Docker", "Python", "SQL"], 2: []}


def test_taxonomy_file(spark, tmp_path):
    from vacantia.sources.tables import read_taxonomy
    (tmp_path / "skills.json").write_text(
        '{"data": [{"name": "A", "type": {"name": "Certification"}},\n {"name": "B", "type": {"name": "Common Skill"}}]}')
    rows = read_taxonomy(spark, str(tmp_path / "skills.json")).collect()
    assert [tuple(r) for r in rows] == [(0, "A", "Certification"), (1, "B", "Common Skill")]
