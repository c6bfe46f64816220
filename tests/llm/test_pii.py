import random
import re

from pyspark.sql import functions as F

from quarrylens.llm import pii

from .cases import CLASHES, awkward, table, with_clashes

SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        turned = [int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(turned) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in SHAPES.items()}


def spans(df):
    return sorted((repr(r.doc_id), {k: [(s.start, s.end) for s in r[k]] for k in pii.KINDS}) for r in pii.personal_data(df).collect()), [r for r in pii.personal_data(df).collect()]


def same(found, rows):
    assert sorted(map(repr, found)) == sorted(map(repr, ((repr(d), brute(t)) for d, t in rows)))


def test_awkward_rows(spark):
    same(spans(with_clashes(table(spark)))[0], [(d, t) for d, t, *_ in awkward()])


def test_random_texts(spark):
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", "_", ".", " ", "+1", "(555)", "-", "4111111111111111", "4111 1111 1111 1111", "1", "22", "10.0.0.1", "256.1.1.1", "007.1.1.1", "é", "\n", "%", "0000000000000000000000000255.1.1.1"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "", "", 0) for k in range(600)]
    same(spans(table(spark, rows))[0], [r[:2] for r in rows])


def test_long_texts_neither_recurse_nor_stall(spark):
    rows = [(1, "1 " * 50_000, "", "", 0), (2, "9" * 100_000, "", "", 0), (3, "a." * 50_000, "", "", 0), (4, "10.0.0.1 " * 3000 + "+1 555 010 2030", "", "", 0), (5, "a" * 100_000 + "@b.c", "", "", 0)]
    same(spans(table(spark, rows))[0], [r[:2] for r in rows])


def test_empty_table(spark):
    assert pii.personal_data(table(spark, [])).collect() == []
    assert pii.redacted(table(spark, [])).collect() == []


def campaign():
    """Letters that name members' numbers in the same words, some of them in a shape that is known."""
    rows = [(k, f"filler {k} words here. Please contact member at m{k}@mail.example.org soon", "", "", 0) for k in range(6)]
    rows += [(100 + k, f"other text {k} indeed. Please contact member at ref-{k}{k}-8841{k} today", "", "", 0) for k in range(2)]
    rows += [(200 + k, f"the build number was build-2024{k}11 and all is well", "", "", 0) for k in range(6)]
    return rows


def test_patterns_discover_unseen_identifiers_and_leave_others(spark):
    rows = pii.personal_data(table(spark, campaign())).collect()
    found = {r.doc_id: [s.text for s in r.id] for r in rows if r.id}
    assert found == {100: ["ref-00-88410"], 101: ["ref-11-88411"]}


def test_second_round_uses_what_the_first_found(spark):
    rows = campaign()
    ids = ["ref-00-88410", "ref-11-88411", "ref-22-88412"]
    rows.append((102, f"third text. Please contact member at {ids[2]} today", "", "", 0))
    rows += [(300 + k, f"again here. Our file holds {x} since then", "", "", 0) for k, x in enumerate(ids)]
    rows.append((400, "again there. Our file holds ref-99-77777 since then", "", "", 0))
    found = {r.doc_id: [s.text for s in r.id] for r in pii.personal_data(table(spark, rows)).collect() if r.id}
    assert found[400] == ["ref-99-77777"] and not any(k >= 200 and k < 300 for k in found)


def test_rounds_go_on_until_nothing_new_is_found(spark):
    places = ["amber brook", "cedar dune", "ember fjord", "grove heath", "inlet jetty", "knoll larch"]
    rows = []
    for r, place in enumerate(places):
        known = [f"m{r}{k}@mail.example.org" for k in range(2)] + [f"ref-{r}{r}-8841{r}" if r else "m9@mail.example.org"]
        rows += [(10 * r + k, f"our {place} {x} now", "", "", 0) for k, x in enumerate([*known, f"ref-{r + 1}{r + 1}-8841{r + 1}"])]
    found = {s.text for r in pii.personal_data(table(spark, rows)).collect() for s in r.id}
    assert found == {f"ref-{r}{r}-8841{r}" for r in range(1, 7)}


def test_starts_and_single_words_are_contexts(spark):
    rows = [(k, f"SSN: m{k}@mail.example.org", "", "", 0) for k in range(6)] + [(10, "SSN: ref-00-88410 it is", "", "", 0)]
    rows += [(20 + k, f"m{k}{k}@mail.example.org wrote this", "", "", 0) for k in range(12)] + [(50, "ref-11-88411 wrote this", "", "", 0)]
    rows += [(60 + k, f"Build: build-2024{k}11 is well", "", "", 0) for k in range(3)]
    found = {r.doc_id: [s.text for s in r.id] for r in pii.personal_data(table(spark, rows)).collect() if r.id}
    assert found == {10: ["ref-00-88410"], 50: ["ref-11-88411"]}


def test_signs_of_a_seed_lead_to_others(spark):
    rng = random.Random(3)

    def secret():
        return "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "07"

    rows = [(k, f"word{chr(97 + k)} some text token = \"{secret()}\" and on", "", "", 0) for k in range(4)]
    rows += [(10 + k, f"other {chr(97 + k)} text token => \"{x}\" and on", "", "", 0) for k, x in enumerate([m for r in rows for m in re.findall('[0-9a-f]{40}', r[1])])]
    rows += [(20, f"never seen before token => \"{secret()}\" here", "", "", 0), (30, f"the commit {secret()} is fine, the digest: {secret()} too", "", "", 0), (31, "a token of 2024-11-26 and a secret 12345678", "", "", 0)]
    found = {r.doc_id: [s.text for s in r.id] for r in pii.personal_data(table(spark, rows)).collect()}
    assert all(len(found[r[0]]) == 1 for r in rows if r[0] <= 20) and not found[30] and not found[31]


def discovered_by_hand(rows):
    """The whole second step in plain Python."""
    token, letters = re.compile(r"(?<![^\W_0-9]|[0-9_-])(?=[A-Za-z0-9_-]*[0-9][A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8,}+(?![^\W\d_])"), r"[^\W\d_]+"
    seed = re.compile(pii.SEEDS.replace(r"[^\p{L}0-9]", r"[\W_]").replace("(?i)", ""), re.I)
    edges, places = {}, []
    for doc, text in rows:
        base = sorted((a, b) for spans in brute(text).values() for a, b in spans)
        spots = []
        for spans in [*brute(text).values(), [m.span() for m in token.finditer(text) if not any(a < m.end() and m.start() < b for a, b in base)]]:
            kind_is_token = spans and spans[0] not in base
            matches = [m.span() for m in token.finditer(text)] if kind_is_token else None
            for a, b in spans:
                if kind_is_token:
                    before = max([y for x, y in matches if y <= a], default=0)
                else:
                    kind = next(k for k, v in brute(text).items() if (a, b) in v)
                    before = max([m.end() for m in re.finditer(SHAPES[kind], text) if m.end() <= a], default=0)
                context = text[max(before, a - pii.BEFORE) : a]
                spots.append((a, b, context, not kind_is_token or bool(seed.search(context)), kind_is_token and bool(seed.search(context))))
                if kind_is_token:
                    places.append((doc, a, b, text[a:b]))
        for a, b, context, known, own in spots:
            pieces = re.findall(letters + r"(?:[\W\d_])*", context.lower())
            mark = "^" if a == len(context) else "~"
            if len(context) < pii.BEFORE or len(pieces) < 2:
                pieces = [mark, mark, *pieces]
            words = [re.match(f"{letters}|.", x)[0] for x in pieces]
            for i in range(len(words)):
                end = i == len(words) - 1
                instance = (text[a:b] if end else words[i + 1], end)
                patterns = [f"{words[i - 1]} {words[i]}"] if i else []
                if re.match(letters + r"\s*[\d\W_]", pieces[i]) and re.search(r"[^\s]", re.sub(f"^{letters}", "", pieces[i])):
                    patterns.append(pieces[i] + "|")
                for p in patterns:
                    old = edges.get((p, instance), (False, False))
                    edges[p, instance] = (old[0] or (end and known), old[1] or (end and own))
    known = {i for (_, i), (k, _) in edges.items() if k and i[1]}
    found = {i[0] for (_, i), (_, s) in edges.items() if s}
    by = {}
    for p, i in edges:
        by.setdefault(p, set()).add(i)
    while True:
        trust = {}
        for p, instances in by.items():
            n = sum(i in known for i in instances)
            total = n + sum(0.5 if i[1] else 1.0 for i in instances if i not in known)
            if n >= pii.SUPPORT and n >= total * pii.CONFIDENCE:
                trust[p] = n / (total + 1)
        new = set()
        for i in {i for _, i in edges if i[1]} - known:
            doubt = 1.0
            for p in trust:
                doubt *= 1 - trust[p] if i in by[p] else 1
            if doubt <= 1 - pii.CONFIDENCE * pii.SUPPORT / (pii.SUPPORT + 1) + 1e-12:
                new.add(i)
        if not new:
            break
        known |= new
        found |= {i[0] for i in new}
    return sorted((d, a, b) for d, a, b, x in places if x in found)


def test_discovery_like_plain_python(spark, data):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["call", "at:", "ref =", "a@b.cd", "10.0.0.1", f"id-{rng.randrange(40)}-7788", "it", "x1234567", "no.", "token:"]) for _ in range(rng.randint(1, 14)))) for k in range(300)]
    rows += [(r.doc_id + 1000, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, s.start, s.end) for r in got for s in r.id) == discovered_by_hand(rows)


def test_redaction_leaves_clean_documents_alone(spark):
    docs = with_clashes(table(spark))
    kept = {(repr(r.doc_id), r.n_chars): r for r in pii.redacted(docs).collect()}
    assert len(pii.redacted(docs).collect()) == len(awkward())
    row = next(r for (d, _), r in kept.items() if d == "8")
    assert row.text == "write to <EMAIL> or <PHONE>, card <CARD> at <IP> now" and row.n_chars == len(row.text) and row.email == CLASHES["email"]
    before = sorted(repr((d, t, n)) for d, t, _, _, n in awkward() if d != 8)
    assert sorted(repr((r.doc_id, r.text, r.n_chars)) for r in pii.redacted(docs).where(F.col("doc_id").isNull() | (F.col("doc_id") != 8)).collect()) == before


def test_redaction_cuts_overlapping_spans_whole(spark):
    many = "é10.0.0.1 a@b.c, " * 700
    rows = [(1, "ring +1 555 010 2030@x.y now", "", "", 0), (2, "+1 555 10.0.0.1 203", "", "", 0), (3, many, "", "", 0)]
    found = {r.doc_id: r.text for r in pii.redacted(table(spark, rows)).collect()}
    assert found == {1: "ring <PHONE> now", 2: "<PHONE>", 3: "é<IP> <EMAIL>, " * 700}


def test_plan_has_no_python(spark):
    df = pii.redacted(table(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
