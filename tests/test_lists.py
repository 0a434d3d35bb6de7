"""Lists of texts against Python's own reading of them."""

import ast
import random

from vacantia.functions import text as T


def python(text):
    if text is None:
        return None
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        return None
    return value if isinstance(value, list) and all(x is None or isinstance(x, str) for x in value) else None


def test_lists_that_python_writes(one):
    rng = random.Random(22)
    letters = ["a", "é", "梦", "😀", "'", '"', "\\", "\n", "\t", "\r", "\x00", "\x07", "\x7f", " ", " ", ",", "[", "]", "None", "\\n", "\x1b"]
    lists = [[rng.choice([None, *["".join(rng.choices(letters, k=rng.randrange(6))) for _ in range(5)]]) for _ in range(rng.randrange(5))]
             for _ in range(600)]
    texts = [repr(x) for x in lists] + [ascii(x) for x in lists]
    assert one(T.parse_list, *texts) == lists + lists


def test_lists_by_hand(one):
    texts = ["[]", " [ ] ", "['a','b']", "['a', ]", "['a' \"b\" 'c', 'd']", "[\n 'a',\n 'b'\n]", r"['\x41é\U0001F600\101\60\n\q\'\"']", "['a\\\nb']",
             "[None]", "['None', None]", "['a, b', '[c]']", "['']", "['' '']",
             # no lists of texts
             "", "x", "['a'", "'a'", "['a' 1]", "[1]", "['a',,'b']", "[,]", "['a\nb']", r"['\x4']", r"['\u00']", "[b'a']", "['a'] x", "[['a']]", "{'a'}",
             "[None None]", "['a' None]", r"['\']", None]
    assert one(T.parse_list, *texts) == [python(t) for t in texts]


def test_what_python_cannot_write_either(one):
    assert one(T.parse_list, r"['\ud83d']", r"['\U00110000']", r"['\\ud83d']", r"['\N{BULLET}']") == [None, None, ["\\ud83d"], None]


def test_long_lists(one):
    many = [f"it's {i} \\ \n" for i in range(20_000)]
    assert one(T.parse_list, repr(many), repr(["\\" * 100_000])) == [many, ["\\" * 100_000]]
