import re

import numpy as np
from mmcohort.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs):
    out = []
    for d, text in docs:
        w, starts, labels = words(text), [], set()
        for phrase, label in L.BASE_PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        out.append((str(d), len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def base(df):
    return sorted(((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in df.collect()), key=str)


def test_documents(spark, sf_dir, documents):
    want = brute([(d["doc_id"], d["text"]) for d in documents])
    assert base(L.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == want
    assert any(r[2] for r in want)


def test_base_phrases_in_odd_places(spark):
    docs = [
        (1, "MIT License mit license; MIT\nLICENSE"), (2, "the GNU General Public License, Apache-License"), (3, "mit mit license license"),
        (4, "mitlicense general public"), (5, "general general public license public license"), (6, "license mit"), (7, None), (8, ""),
        (9, "x " * 5000 + "apache license"), (None, "mit license"),
    ]
    assert base(L.scan(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_edges(edge_docs, no_docs):
    assert base(L.scan(edge_docs)) == brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert L.scan(no_docs).collect() == []


def test_template_spans(spark):
    t = L.TEMPLATES
    mit, bsd = t["mit"][0], t["bsd"][0]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 17)  # words lost
    docs = [(1, "Intro words. " + mit + " trailing"), (2, broken), (3, "nothing of that kind, in the software"), (4, bsd + " x " * 100 + mit), (5, mit[: len(mit) // 5])]
    out = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1]["labels"] == "mit" and out[1]["base_labels"] == "" and out[1]["score"] == 1.0
    assert (out[1]["span_first"], out[1]["span_last"]) == ([2], [2 + len(words(mit)) - 1])
    assert out[2]["labels"] == "mit" and 0.5 <= out[2]["score"] < 1
    assert out[3]["labels"] == "" and out[3]["score"] < 0.5
    assert out[4]["labels"] == "bsd,mit" and out[5]["labels"] == ""


def test_automaton_gives_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(30):
        seqs = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(4)]
        auto = L.Automaton(seqs)
        text = rng.integers(0, 4, 60).tolist()
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for j, (v, n) in enumerate(auto.walk(text)):
            longest = max((k for k in range(1, j + 2) if tuple(text[j - k + 1 : j + 1]) in subs), default=0)
            assert n == longest
            if n:
                own = text[j - n + 1 : j + 1]
                want = {t: [i + n - 1 for i in range(len(s)) if s[i : i + n] == own] for t, s in enumerate(seqs)}
                assert auto.ends[v] == {t: x for t, x in want.items() if x}


def brute_chains(text, templates):
    """Matching statistics by comparing substrings, then the chaining rule as the docstring states it."""
    def stands(t, x):
        return [i + len(x) - 1 for i in range(len(t) - len(x) + 1) if t[i : i + len(x)] == x]

    longest = [max((n for n in range(1, j + 2) if any(stands(t, text[j - n + 1 : j + 1]) for t in templates)), default=0) for j in range(len(text))]
    best, live = {}, {}
    for j, n in enumerate(longest):
        if n < L.MIN_MATCH or (j + 1 < len(text) and longest[j + 1] > n):
            continue
        for k, t in enumerate(templates):
            places = stands(t, text[j - n + 1 : j + 1])
            if not places:
                continue
            c = live.get(k)
            later = [e for e in places if c and e > c[3] and j - n - c[2] <= L.MAX_GAP]
            if later:
                c[0] += min(n, later[0] - c[3], j - c[2])
                c[2], c[3] = j, later[0]
            else:
                c = live[k] = [n, j - n + 1, j, places[0]]
            share = min(1.0, c[0] / len(t))
            if share > best.get(k, (0.0, 0, 0))[0]:
                best[k] = (share, c[1], c[2])
    return best


def test_spans_equal_brute_force():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(12)]
    again = ["the", "same", "passage", "stands", "twice"]
    for _ in range(25):
        a = rng.choice(vocab, 30).tolist()
        templates = [a[:10] + again + a[10:18] + again + a[18:], rng.choice(vocab, 20).tolist(), again * 3]
        s = L.Scanner({}, {f"t{i}": [" ".join(t)] for i, t in enumerate(templates)})
        text = []
        for _ in range(6):
            t = templates[rng.integers(3)]
            lo = int(rng.integers(len(t)))
            text += t[lo : lo + int(rng.integers(2, 25))] + rng.choice(vocab + ["x", "y"], rng.integers(0, 8)).tolist()
        _, got_ = s.scan(s.tokens(L.words_of(" ".join(text))))
        assert got_ == brute_chains(text, templates)
    whole = templates[0]
    share, first, last = s.scan(s.tokens(L.words_of(" ".join(["x"] + whole + ["x"]))))[1][0]
    assert (share, first, last) == (1.0, 1, len(whole))


def test_phrases_of_one_word_and_whole_texts(spark):
    docs = [(1, "Copyleft! all rights reversed copyleft"), (2, "nothing"), (3, " ".join(f"l{i}" for i in range(5000)))]
    out = {r["doc_id"]: r for r in L.scan(
        spark.createDataFrame(docs, "doc_id long, text string"), phrases={"copyleft": "copyleft", "all rights": "rights"},
        templates={"long": [" ".join(f"l{i}" for i in range(6000))]},
    ).collect()}
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (3, 0, 4, "copyleft,rights")
    assert out[2]["n_base"] == 0 and out[3]["span_labels"] == ["long"] and out[3]["span_cover"] == [5000 / 6000]
