"""License blocks against brute force: every stretch of a text, every template."""

import random
import time

import pytest
import zstandard

from threadloom.llm import license_scan as L


def plain_answer(text, templates, tolerance=L.TOLERANCE):
    """All stretches (first word, end word, license) that a template's wording confirms, and for each stretch the winner by the
    share of bytes saved."""
    said = list(L._WORD.finditer(text))
    words = [m.group().lower() for m in said]
    given = {k: zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
    known, out = L.Templates(templates, tolerance), []
    for low in range(len(words)):
        for high in range(low + 1, len(words) + 1):
            able = []
            for k in templates:
                most = int(tolerance * len(known.words[k]))
                if abs(high - low - len(known.words[k])) <= most:
                    missing, added = known.differences(k, words[low:high])
                    if max(len(missing), len(added)) <= most and not any(c.isdigit() for w in (*missing, *added) for c in w):
                        able.append(k)
            if able:
                block = text[said[low].start() : said[high - 1].end()].encode()
                plain = len(zstandard.ZstdCompressor(level=19).compress(block))
                share = {k: (plain - len(given[k].compress(block))) / plain for k in able}
                best = min(able, key=lambda k: (-share[k], k))
                if share[best] > 0:
                    out.append((said[low].start(), said[high - 1].end(), best))
    return out


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if any(c.isdigit() for c in words[at]):
            continue
        if kind == 0:
            words[at] = rng.choice(["other", "each", "thing"])
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, rng.choice(["very", "new"]))
    return " ".join(words)


SMALL = {k: L.TEMPLATES[k] for k in ("MIT-notice", "Apache-2.0-notice", "Apache-2.0", "GPL-3.0-notice", "GPL-2.0-notice", "CC-BY-4.0", "CC-BY-NC-4.0", "BSD", "MPL-2.0-header")}


@pytest.mark.parametrize("seed", range(12))
def test_blocks_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    known, parts = L.Templates(SMALL), []
    for _ in range(rng.randrange(1, 4)):
        parts.append(" ".join(rng.choice("the river under license and public mill of general this file".split()) for _ in range(rng.randrange(12))))
        parts.append(edited(rng, rng.choice(list(SMALL.values())), rng.choice([0, 0, 1, 2, 3])))
    text = rng.choice([" ", "\n", ", "]).join(parts)
    want, got = plain_answer(text, SMALL), known.told(text)
    for start, end, name, *_ in got:
        assert (start, end, name) in want
    for start, end, name in want:  # every stretch that agrees lies on a block that was told
        assert any(s < end and start < e for s, e, *_ in got), (text, start, end, name)


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_every_template_is_told_from_the_others(name):
    known, rng = L.Templates(L.TEMPLATES), random.Random(1)
    text = "Copyright 2020 Nobody. All of it.\n\n" + L.TEMPLATES[name] + "\n\nint main() { return 0; }"
    got = known.told(text)
    assert [g[2] for g in got] == [name] and got[0][4:7] == (0, 0, "")
    assert text[got[0][0] : got[0][1]].split() == L.TEMPLATES[name].rstrip(".:/").split()
    few = edited(rng, L.TEMPLATES[name], known.most[name] // 3)
    assert [g[2] for g in known.told("x " + few + " y")] == [name]


def at_full_tolerance(rng, words, missing, added, where):
    """The words with that many taken out and that many put in, at the start, the end, both or anywhere; none with a digit goes."""
    out, n = list(words), len(words)
    span = lambda: {"start": rng.randrange(min(n, 2 * missing + 3)), "end": n - 1 - rng.randrange(min(n, 2 * missing + 3)), "both": rng.choice([0, 1, 2, n - 1, n - 2, n - 3]) % n, "any": rng.randrange(n)}[where]
    gone = set()
    for _ in range(60):
        at = span()
        if len(gone) < missing and not any(c.isdigit() for c in words[at]):
            gone.add(at)
    put = [span() for _ in range(added)]
    for k in range(n):
        fresh = ["zulu"] * put.count(k)
        out[k] = fresh + ([] if k in gone else [words[k]]) if k or where == "any" else ([] if k in gone else [words[k]]) + fresh
    return [w for part in out for w in part]


@pytest.mark.parametrize("where", ["start", "end", "both", "any"])
def test_no_edit_within_the_tolerance_is_lost(where):
    rng, known, planted, lost = random.Random(where), L.Templates(L.TEMPLATES), 0, []
    for name, words in known.words.items():
        for _ in range(12 if len(words) < 100 else 4):
            for missing, added in ((known.most[name], known.most[name]), (known.most[name], 0), (0, known.most[name])):
                block = at_full_tolerance(rng, words, missing, added, where)
                if not block or not known.agrees(name, block):
                    continue
                planted += 1
                text = f"Seven mills stand here. {' '.join(block)} ; and so on they stood."
                low = text.index(" ".join(block))
                if not any(s < low + len(" ".join(block)) and low < e for s, e, *_ in known.told(text)):
                    lost.append((name, text))
    assert planted > 250 and not lost, (len(lost), planted, lost[:3])


def test_a_word_added_before_the_last():
    known = L.Templates(L.TEMPLATES)
    got = known.told("This work is licensed under the GNU General Public License, version number 2.")
    assert [(g[2], g[6]) for g in got] == [("GPL-2.0-notice", "+number")]
    assert [g[2] for g in known.told("It is licensed under the GNU General Public License, version 3.")] == []  # two words of twelve are too many
    assert [(g[2], g[6]) for g in known.told("The work is licensed under the GNU General Public License, version 3.")] == [("GPL-3.0-notice", "-this")]


def test_alignment_keeps_most_words():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcd1") for _ in range(rng.randrange(9))] for _ in range(2))
        missing, added = L.aligned(a, b)
        best = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                up = best[i - 1][j - 1]
                best[i][j] = max(best[i - 1][j], best[i][j - 1], (up[0] + (x == "1"), up[1] + 1) if x == y else up)
        assert len(a) - len(missing) == len(b) - len(added) == best[-1][-1][1]
        assert a.count("1") - missing.count("1") == best[-1][-1][0]


def test_time_grows_with_the_text():
    known = L.Templates(L.TEMPLATES)
    spent = {}
    for piece in ("licence copyright permission is ", "licensed under the apache license ", L.TEMPLATES["MIT-notice"] + " ", L.TEMPLATES["MIT"][:200] + " "):
        for size in (1 << 20, 5 << 20):
            text = piece * (size // len(piece))
            began = time.time()
            known.told(text)
            spent[size] = time.time() - began
        assert spent[5 << 20] < 60 and spent[5 << 20] < 12 * max(spent[1 << 20], 0.2)


def test_prefilter_never_loses_a_block():
    words = L.telling_words(L.TEMPLATES)
    for t in L.TEMPLATES.values():
        own = L.words(t)
        assert len(set(own) & set(words)) > int(L.TOLERANCE * len(own))
    assert L.telling_words({"digits": "1 2 3"}) is None and L.telling_words({}) == []
