"""Whole queries over small tables, said again without the operators' own functions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from limber.llm import html_extract, mixing, toxicity

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


def topic(text):
    if re.search("(?i)licen[sc]e", text):
        return "licence"
    if re.search(r"[\w.]@[\w-]+\.\w|\+\d[\d ()-]{7,}", text):
        return "contact"
    return "list" if re.search(r" [|•] ", text) else "prose"


def fitted(cells, wants, caps):
    """Dictionaries of cells raked one slice after the other; each slice's factor by bisection."""
    total = sum(cells.values())
    weight = {c: t / total for c, t in cells.items() if t}
    for _ in range(150):
        for axis, want in enumerate(wants):
            for value, share in want.items():
                mine = [c for c in weight if c[axis] == value]
                has = lambda f: sum(min(weight[c] * f, caps[c]) for c in mine)  # noqa: B023, E731
                low, high = 0.0, 1.0
                while has(high) < share and high < 1e12:
                    high *= 2
                for _ in range(80):
                    middle = (low + high) / 2
                    low, high = (middle, high) if has(middle) < share else (low, middle)
                for c in mine:
                    weight[c] *= high
    return {c: min(w, caps[c]) for c, w in weight.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_weights(spark, seed):
    """The production mixture: tempered sources and languages, topics as they are, 60 % of all words, a hash of the id."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        text = "word " * int(rng.integers(5, 90)) + ["", "a licence", "a@b.de", "x | y"][int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]
        rows.append((i, text, ["en", "de"][int(rng.random() < 0.4)], f"s{int(rng.choice(3, p=[0.5, 0.3, 0.2]))}"))
    got = {r["doc_id"]: r for r in mixing.mixing_weights(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    cells, of = collections.Counter(), {}
    for i, text, lang, source in rows:
        of[i] = (source, lang, topic(text))
        cells[of[i]] += len(words(text))
    total, wants = sum(cells.values()), []
    for axis, power in enumerate((0.7, 0.7, 1.0)):
        margin = collections.Counter()
        for c, n in cells.items():
            margin[c[axis]] += n
        scaled = {v: n**power for v, n in margin.items()}
        wants.append({v: x / sum(scaled.values()) for v, x in scaled.items()})
    share = fitted(cells, wants, {c: n / total / 0.6 for c, n in cells.items()})
    for i, r in got.items():
        c = of[i]
        assert (r["source"], r["lang"], r["topic"]) == c and r["n_tokens"] == len(words(rows[i][1]))
        assert math.isclose(r["probability"], min(1, share[c] * total * 0.6 / cells[c]), rel_tol=2e-4)
        drawn = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["sampled"] == (drawn < r["probability"])


def sigmoid(x):
    return 1 / (1 + math.exp(-min(30, max(-30, x))))


def window_score(model, window):
    """The network over one window, a number at a time."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    size = toxicity.HIDDEN
    known = []
    for token in window:
        word = token.strip(".,;:!?\"'()[]{}…«»“”*#$%&|") or token
        marked = f"<{word}>"
        grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] or [marked]
        letters = sum(p["letters"][zlib.crc32(g.encode()) % toxicity.LETTER_ROWS] for g in grams) / len(grams)
        known.append(np.r_[p["words"][model.known.get(word, 0)], letters])
    states = []
    for d in "fb":
        state, out = np.zeros(size), {}
        for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
            x, h = known[t] @ p[f"w{d}"] + p[f"c{d}"], state @ p[f"u{d}"]
            new = np.zeros(size)
            for j in range(size):
                z, r = sigmoid(x[j] + h[j]), sigmoid(x[size + j] + h[size + j])
                n = math.tanh(x[2 * size + j] + r * h[2 * size + j])
                new[j] = (1 - z) * n + z * state[j]
            out[t] = state = new
        states.append(out)
    both = [np.r_[states[0][t], states[1][t]] for t in range(len(window))]
    if not both:
        return float(p["out_b"][0])
    e = [float(np.tanh(s @ p["att"]) @ p["att_v"]) for s in both]
    a = [math.exp(v - max(e)) for v in e]
    return float(sum(w * s for w, s in zip(a, both, strict=True)) / sum(a) @ p["out"] + p["out_b"][0])


def text_score(model, text):
    tokens = []
    for w in (text or "").lower().split():
        tokens += [w] if len(w) <= 32 else [w[i : i + 32] for i in range(0, len(w) - 4, 28)]
    starts = range(0, max(1, len(tokens) - 32 + 16), 16)
    scores = sorted((window_score(model, tokens[s : s + 32]) for s in starts), reverse=True)
    seen = np.array([scores[0], scores[1] if len(scores) > 1 else scores[0], sum(scores) / len(scores)])
    return sigmoid(float(np.r_[(seen - model.mean) / model.scale, 1.0] @ model.last)), len(scores)


def test_toxicity_scores(spark):
    """Every text of a table, by a fitted model, against loops."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"v{rng.integers(300)}" + "." * int(rng.random() < 0.1) for _ in range(n))
    model = toxicity.fit([prose(70) + (" vilest scum" if i % 2 else "") for i in range(80)], [i % 2 for i in range(80)], 0.3)
    texts = [prose(n) for n in (1, 5, 31, 32, 33, 47, 48, 49, 64, 130)] + ["", None, " \n", "x" * 33, "ab" * 200, "Vilest SCUM!", prose(40) + " vilest scum " + prose(40), "«ünïcode» 字字字字字", "... ,,, !!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in toxicity.score_texts(df, model).collect()}
    for i, text in enumerate(texts):
        score, n = text_score(model, text)
        assert got[i]["n_windows"] == n and math.isclose(got[i]["score"], score, abs_tol=2e-4), (i, text)


def test_extracted_pages(spark):
    """Made pages whose articles are known, of every kind of furniture: the text is the article's and nothing else."""
    rng = np.random.default_rng(12)
    sentence = lambda n: " ".join(f"wort{rng.integers(900)}" for _ in range(n)).capitalize() + "."
    furniture = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{i}>Link {i}</a></li>' for i in range(5))}</ul></nav>", lambda: f'<div class="ad">{sentence(8)}</div>', lambda: f"<aside><p>{sentence(15)}</p></aside>", lambda: f'<div id="cookie-notice"><p>{sentence(20)}</p></div>',
        lambda: f"<form><label>Mail</label><p>{sentence(6)}</p></form>", lambda: f'<section class="comments"><p>{sentence(25)}</p></section>', lambda: f"<footer>{sentence(10)}</footer>", lambda: f'<div class="newsletter-signup"><p>{sentence(9)}</p></div>', lambda: "<script>var a = '<p>';</script><style>p{}</style>",
    ]
    rows = []
    for i in range(60):
        parts = [sentence(int(rng.integers(6, 40))) for _ in range(int(rng.integers(2, 9)))]
        inner = "".join(f"<{t}>{p}</{t}>" for p, t in zip(parts, rng.choice(["p", "p", "p", "h2", "blockquote"], len(parts)), strict=True))
        wrapped = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<main><div class="cookie-recipe">{}</div></main>'])
        around = [furniture[int(k)]() for k in rng.permutation(len(furniture))]
        cut = int(rng.integers(len(around) + 1))
        rows.append((i, "u", f"<html><body>{''.join(around[:cut])}{wrapped.format(inner)}{''.join(around[cut:])}</body></html>", " ".join(parts)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wanted string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    assert [i for i, _, _, want in rows if got[i]["text"] != want or got[i]["n_chars"] != len(want)] == []
