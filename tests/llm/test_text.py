import re

import numpy as np
import pyarrow as pa

from mmcohort.llm import text as T

ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def split(s, kind):
    return (ALNUM_WORD if kind is T.ALNUM else SPACE_WORD).findall(lower(s))


TEXTS = [
    "The QUICK, brown-fox  É Éé ß\x00z", "", None, "a", "\x0b\x1c x\x85y z", "end", "start!" * 50,
    "ab " * 3000, "w" * 5000, "[x]`{y}~\x7f9:", "Straße ÅNGSTRÖM İ", " lead and trail \n",
]


def check(texts, kind, limit=1 << 22):
    names = {}
    for lo, hi, t in T.text_groups(pa.array(texts, pa.string()), kind, limit):
        for i in range(lo, hi):
            h = t.hash[t.at[i - lo] : t.at[i - lo + 1]]
            want = split(texts[i] or "", kind)
            assert len(h) == len(want), (i, want[:5])
            for w, x in zip(want, h):
                assert names.setdefault(w, int(x)) == int(x)
    assert len(set(names.values())) == len(names)


def test_words_agree_with_the_patterns():
    for kind in (T.ALNUM, T.SPACE):
        check(TEXTS, kind)
        check(TEXTS, kind, limit=7)
        check([], kind)


def test_slices_do_not_change_hashes(monkeypatch):
    whole = [t.hash.tolist() for _, _, t in T.text_groups(pa.array(TEXTS), T.ALNUM)]
    monkeypatch.setattr(T, "SLICE", 16)
    assert whole == [t.hash.tolist() for _, _, t in T.text_groups(pa.array(TEXTS), T.ALNUM)]
    check(TEXTS, T.SPACE)


def test_real_documents(documents):
    texts = [d["text"] for d in documents]
    for kind in (T.ALNUM, T.SPACE):
        check(texts, kind)


def test_grams():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(T.grams(h, 3)) == 5 and len(T.grams(h[:2], 3)) == 0
    assert T.grams(h[2:5], 3)[0] == T.grams(h, 3)[2]
