from __future__ import annotations

import hashlib
import random
import re

from scriptorium.llm import pii


def luhn(d):
    s = [int(c) for c in d][::-1]
    return sum(s[::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def brute(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, p, ok in rules:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])]
    return out


def test_base_spans_equal_plain_search():
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "0", "7", "4", "255", "@", "@", ".", ".", "-", "+", " ", "(", ")", "_", "%", "\n", "a@b.co", "4111111111111111", "😀"]
    for _ in range(6000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t)] == brute(t), repr(t)
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+" * 100_000, "a@b." * 30_000):
        pii.base_spans(t)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(None, None), (0, ""), (1, "x")]
    rows += [(i, f"é wort bitte mail user{i}@mail.example.com jetzt") for i in range(2, 12)]
    rows += [(20, "so bitte mail robert_at_42 now"), (21, "the other mail robert_at_42 now"), (22, "bitte lies mail 12345678 nie")]
    rows += [(30 + i, "of the " * 30 + f"of the 10.0.0.{i} of the 12345678") for i in range(6)]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        base = brute(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[d].spans.split(",")[: len(base)] == (base or got[d].spans.split(",")[:0])
    assert got[20].spans == "context_email:14:26" and got[20].n_context == 1
    assert got[21].spans == "" and got[22].spans == ""
    assert all(got[30 + i].n_context == 0 for i in range(6))


def test_empty(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_bootstrap(rows, min_seeds=3, min_confidence=0.5, rounds=3):
    """(row, kind, start, end) that the method adds, over lists and dicts alone."""
    kinds = ["email", "ip", "card", "phone"]
    edges, own, totals, tokens = {}, {}, {}, []
    for row, t in enumerate(rows):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        low = [w.lower() if w.isascii() else w for _, _, w in words]
        for a, b in zip(low, low[1:]):
            totals[a, b] = totals.get((a, b), 0) + 1
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute(t))]
        taken = set()
        for k, a, b in base:
            at = [i for i, (s, e, _) in enumerate(words) if e > a and s < b]
            taken |= set(at)
            if at and at[0] >= 2:
                edges[tuple(low[at[0] - 2 : at[0]]), t[a:b].lower()] = edges.get((tuple(low[at[0] - 2 : at[0]]), t[a:b].lower()), 0) + 1
                own[t[a:b].lower()] = min(own.get(t[a:b].lower(), 9), kinds.index(k))
        for i, (s, _, w) in enumerate(words):
            core = w.strip("\"'()[]{}<>.,;:!?*#$%&|")
            if i >= 2 and i not in taken and re.search("[0-9@]", w) and len(core) >= 6:
                key = (tuple(low[i - 2 : i]), core.lower())
                edges[key] = edges.get(key, 0) + 1
                at = s + w.index(core)
                tokens.append((row, key, at, at + len(core)))
    belief = {v: (1.0 if v in own else 0.0, own.get(v)) for _, v in edges}
    share = {}
    for r in range(rounds):
        share = {}
        for p in {p for p, _ in edges}:
            mine = [(v, n) for (q, v), n in edges.items() if q == p]
            seeds = [(n * belief[v][0], -belief[v][1]) for v, n in mine if belief[v][0] >= min_confidence]
            if len(seeds) >= min_seeds:
                share[p] = (min(1.0, sum(n * belief[v][0] for v, n in mine) / totals[p]), -max(seeds)[1])
        if r < rounds - 1:
            for v in belief:
                by = [share[p] for p, w in edges if w == v and p in share and share[p][0] >= min_confidence]
                if v not in own:
                    doubt = 1.0
                    for c, _ in by:
                        doubt *= 1 - min(c, 0.999999)
                    belief[v] = (1 - doubt, -max((c, -k) for c, k in by)[1]) if by else (0.0, None)
    good = {p: k for p, (c, k) in share.items() if c >= min_confidence}
    return sorted((row, kinds[good[key[0]]], a, b) for row, key, a, b in tokens if key[0] in good)


def test_bootstrap_equals_a_plain_version_and_spreads_to_new_contexts(spark):
    rng = random.Random(11)
    rows = [f"please mail user{i}@mail.example.com today" for i in range(6)]
    # tokens first found behind "please mail" carry belief to "contact id", which no e-mail follows
    rows += [f"please mail member_{i}x{i} today and contact id member_{i}x{i} later" for i in range(4)]
    rows += ["contact id member_99x99 later", "contact id plain_word later", "call from +49 170 1234567 now", "contact us member_5555 later"]
    rows += [f"call from +49 170 765432{i} now" for i in range(4)] + ["call from 0170-99887766 now", "the ip 10.0.0.1 is", "a number 4111111111111111 here"]
    words = ["mail", "us", "call", "from", "the", "x1y2z3", "q@w", "10.1.1.7", "abc123", "now"]
    rows += [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = []
    for r in pii.find_personal_data(df).collect():
        added = [s.split(":") for s in r.spans.split(",") if s.startswith("context_")]
        assert len(added) == r.n_context and r.n_spans == r.n_context + r.n_email + r.n_ip + r.n_card + r.n_phone
        got += [(r.doc_id, k.removeprefix("context_"), int(a), int(b)) for k, a, b in added]
    want = plain_bootstrap(rows)
    assert sorted(got) == want
    found = {(row, rows[row][a:b]) for row, _, a, b in want}
    assert {(10, "member_99x99"), (18, "0170-99887766")} <= found and not any(row in (11, 13) for row, _ in found)


def test_added_spans_follow_the_listed_kinds_and_any_column_is_kept(spark):
    rows = [f"send mail u{i}@a.example.com or fast call +49 170 765432{i} ok" for i in range(5)] + ["fast call 0170-99887766 then send mail nobody_1234 end"] * 2
    df = spark.createDataFrame([(1, t, 5, "z") for t in rows], "doc_id long, text string, __row int, n_spans string").repartition(2)
    got = pii.find_personal_data(df).collect()
    last = [r.spans for r in got if r.n_context]
    assert last == ["context_email:39:50,context_phone:10:23"] * 2 and all(r["__row"] == 5 for r in got) and len(got) == 7


def test_a_very_long_text_is_searched_whole(spark):
    text = "word " * 300_000 + "mail end@long.example.com " + "word " * 300_000
    (r,) = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_email == 1 and r.base_spans == f"email:{5 * 300_000 + 5}:{5 * 300_000 + 25}"
