"""Small awkward tables, and plain versions of what the operators compute."""

import random
import re
import string

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, node string, result string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows():
    """Nulls everywhere, empty and long texts, copies, near copies, repeated rows, odd characters."""
    long, near = prose(1, 6000), prose(2, 120).split()
    texts = {
        1: None, 2: "", 3: " \t\n", 4: long, 5: long, 6: " ".join(near), 7: " ".join([*near[:-1], "changed"]),
        8: "…!?\n\n", 9: "Straße ÄÖÜ 東京 1234\nMIT License", 10: "one two", 11: "One, TWO!", 12: "x" * 5000,
        13: prose(3, 40) + " " + prose(9, 30), 14: "A line\nA line\n a LINE \n" + prose(4, 30), 15: "idiot " + prose(5, 20),
    }
    out = [(i, t, "en", "s1" if i % 3 else None, len(t or ""), 1, 0.5, 7, "n", None) for i, t in texts.items()]
    out += [out[5], out[5], (None, "no id here at all", None, None, None, None, None, None, None, None)]
    out += [(100 + i, f"common line\n{prose(100 + i, 25)}", "en", "s2", None, None, None, None, None, None) for i in range(12)]
    return out


def labels():
    return [(i, 0 if i % 4 == 0 else 1, 1 if i == 15 else 0) for i in [*range(1, 16), *range(100, 112), 100]] + [(None, 1, None), (3, None, 1)]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, DOCUMENTS)
