import random
import time

import numpy as np
import pytest

from kinetext.operators import scoring, ter


def plain(pred, ref):
    """The published rule, word by word."""

    def align(h):
        d = [[0] * (len(ref) + 1) for _ in range(len(h) + 1)]
        for i in range(len(h) + 1):
            for j in range(len(ref) + 1):
                ways = [i + j] if not i or not j else [d[i - 1][j - 1] + (h[i - 1] != ref[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1]
                d[i][j] = min(ways)
        i, j, at, bad_h, bad_r = len(h), len(ref), {}, {}, {}
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (h[i - 1] != ref[j - 1]):
                i, j = i - 1, j - 1
                at[j], bad_h[i], bad_r[j] = i, h[i] != ref[j], h[i] != ref[j]
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                bad_h[i] = True
            else:
                j -= 1
                at[j], bad_r[j] = i - 1, True
        return d[-1][-1], at, bad_h, bad_r

    now, made, tried = list(pred), 0, 0
    while True:
        cost, at, bad_h, bad_r = align(now)
        best = None
        for i in range(len(now)):
            for j in range(len(ref)):
                for n in range(1, 11):
                    if abs(i - j) > 50 or i + n > len(now) or j + n > len(ref) or now[i : i + n] != ref[j : j + n]:
                        break
                    if not any(bad_h[k] for k in range(i, i + n)) or not any(bad_r[k] for k in range(j, j + n)) or i <= at[j] < i + n:
                        continue
                    last = None
                    for k in range(j - 1, j + n):
                        to = 0 if k < 0 else at[k] + 1
                        if to == last:
                            continue
                        last, tried = to, tried + 1
                        if to < i:
                            new = now[:to] + now[i : i + n] + now[to:i] + now[i + n :]
                        elif to > i + n:
                            new = now[:i] + now[i + n : to] + now[i : i + n] + now[to:]
                        else:
                            new = now[:i] + now[i + n : n + to] + now[i : i + n] + now[n + to :]
                        found = (cost - align(new)[0], n, -i, -to, new)
                        best = found if best is None or found > best else best
        if best is None or tried >= 1000 or best[0] <= 0:
            return cost + made
        now, made = best[4], made + 1


@pytest.mark.parametrize(
    ("pred", "ref", "want"),
    [
        # The example of the paper that defined the rate: a shift, two substitutions and an insertion.
        ("THIS WEEK THE SAUDIS denied information published in the new york times", "SAUDI ARABIA denied THIS WEEK information published in the AMERICAN new york times", 4),
        ("c d a b", "a b c d", 1), ("a b", "a b", 0), ("a b c d e f", "f a b c d e", 1), ("", "a b", 2), ("a b", "", 2), ("", "", 0), ("x a b c y", "a b c", 2), ("b a", "a b", 1), ("d c b a", "a b c d", 3),
    ],
)
def test_known_rates(pred, ref, want):
    assert ter.edits(pred.split(), ref.split()) == want


def test_rule_against_a_plain_version():
    rng = random.Random(12)
    for n in range(250):
        words = "abcde"[: rng.randint(2, 5)] if n % 2 else [f"w{i}" for i in range(14)]
        ref = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        pred = list(ref)
        for _ in range(rng.randint(0, 3)):
            i, j, k = sorted(rng.randint(0, len(pred)) for _ in range(3))
            pred = pred[:i] + pred[j:k] + pred[i:j] + pred[k:]
            if rng.random() < 0.5 and pred:
                pred[rng.randrange(len(pred))] = rng.choice(words)
        assert ter.edits(pred, ref) == plain(pred, ref), (pred, ref)


def test_two_thousand_words_take_a_second():
    rng = random.Random(1)
    ref = [f"w{rng.randint(0, 600)}" for _ in range(2000)]
    pred = ref[:300] + ref[310:330] + ref[300:310] + ref[330:1200] + [f"x{i}" for i in range(40)] + ref[1200:]
    began = time.perf_counter()
    assert ter.edits(pred, ref) == 41
    other = [f"w{rng.randint(0, 600)}" for _ in range(2000)]
    hard = ter.edits(other, ref)
    assert 1500 < hard <= 2000
    assert time.perf_counter() - began < 4  # two pairs, on a machine that may be busy


def test_distances_without_a_band_are_exact():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 60))] for _ in range(2))
        assert ter.edits(a, b, beam=None, shift=False) == scoring.edit_distance(a, b)


def test_corpus_rate(spark):
    rows = [(1, "C d A b", "a b c D"), (2, None, "a"), (3, "x", None), (4, "", "a a")]
    df = spark.createDataFrame(rows, "id int, pred string, ref string")
    assert scoring.ter(df).first()["ter"] == pytest.approx(100 * (1 + 1 + 1 + 2) / 7)
    assert scoring.ter(df.limit(0)).first()["ter"] is None


def test_alignment_along_the_edge_of_the_band():
    rng = random.Random(3)
    for _ in range(400):
        pred, ref = (np.array([rng.randint(0, 40) for _ in range(rng.randint(1, 160))], np.int32) for _ in range(2))
        cost, at, wrong, missed = ter.alignment(pred, ref)
        assert cost == ter.distances(pred[None], ref)[0]
        kept = np.flatnonzero(~missed)
        assert (pred[at[kept]] == ref[kept]).all() and len(kept) == np.count_nonzero(~wrong)
        assert max(wrong.sum(), missed.sum()) <= cost <= wrong.sum() + missed.sum()
