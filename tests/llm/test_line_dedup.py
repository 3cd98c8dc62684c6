import re

from regidx.llm.line_dedup import drop_recurring_lines


def brute(texts, documents=5, similar=0.5):
    def mask(line):
        tokens = [t for t in re.split(r"[ \t\x0b\f\r]+", line.strip(" ")) if t]
        if not any(constant(t) for t in tokens):
            return " ".join(tokens)
        return " ".join("<*>" if re.search("[0-9]", t) else t for t in tokens)

    def constant(token):
        return token != "<*>" and not re.search("[0-9]", token)

    lines = {i: {mask(l) for l in (t or "").split("\n")} - {""} for i, t in enumerate(texts)}
    leaf = lambda m: (m.count(" "), tuple(m.split(" ")[:3]))
    leaves, n_docs, common = {}, {}, {}
    for i, ms in lines.items():
        for m in ms:
            leaves.setdefault(leaf(m), set()).add(i)
            n_docs[m] = n_docs.get(m, 0) + 1
    for m, n in n_docs.items():
        for place, token in enumerate(m.split(" ")):
            key = (leaf(m), place, token)
            common[key] = common.get(key, 0) + n
    template = {}
    for m in n_docs:
        if len(leaves[leaf(m)]) < documents:
            continue
        tokens = m.split(" ")
        general = [t if common[leaf(m), p, t] >= documents else "<*>" for p, t in enumerate(tokens)]
        kept, later = sum(t != "<*>" for t in general[3:]), len(general[3:])
        alike = kept > 0 and kept >= similar * later and any(map(constant, tokens))
        template[m] = (leaf(m), " ".join(general) if alike else m)
    where = {}
    for i, ms in lines.items():
        for m in ms:
            if m in template:
                where.setdefault(template[m], set()).add(i)
    out = []
    for i, t in enumerate(texts):
        kept, seen = [], set()
        for line in (t or "").split("\n"):
            m = mask(line)
            docs = where.get(template.get(m), ())
            if len(docs) >= documents:
                if i != min(docs) or m in seen:
                    continue
                seen.add(m)
            kept.append(line)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_equals_brute_force(spark, docs_of):
    texts = [None, "", "only here\n\n  \nand here 1"]
    for i in range(8):
        texts.append(f"Own line {i} of words alone\nAll rights reserved\nVisited on day {i} of month {i * 3} by users\nown{chr(97 + i)} x")
        texts.append(f"Signed by\tthe   editor name{chr(97 + i)}x of this paper\nAll rights reserved\nAll  rights reserved\r\n")
    texts += ["The weather in town is cold\nshared twice", "The weather in town is warm\nshared twice", "Ünïcode 中 line\n" * 3]
    texts += ["copied whole\nsecond line of it"] * 6 + ["x " * 50_000]
    # Where the rule of another version would decide otherwise: leading tokens alone, numbers alone, half of the later tokens.
    for i, c in enumerate("pqrstuvw"):
        texts.append(f"It is a k{c} l{c} m{c}\n{i} {i * 7} {i * 3}\n7 7 7\n<*> {i}\nOne of the x{c} same y{c} end\nOne of the x{c} y{c} z{c} end {i}")
        texts.append(f"In one leaf a{c}\nIn one leaf b{c}\nIn one leaf {i}\nBy the way <*> is left {c * 3}")
    texts += ["many in one p\nmany in one q\nmany in one r\nmany in one s\nmany in one t"] * 2
    df = docs_of(texts)
    got = {r.doc_id: r for r in drop_recurring_lines(df.repartition(3)).collect()}
    expected = brute(texts)
    assert {i: r.text for i, r in got.items()} == dict(enumerate(expected))
    for i, t in enumerate(texts):
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert got[i].n_chars == (len(expected[i]) if t is not None else 0)
    assert expected[3] != texts[3] or "All rights reserved" in expected[3]
    assert sum("All rights reserved" in (t or "") for t in expected) == 1


def test_extra_columns_and_repeats(spark):
    rows = [(1, "a b\nc", 5, "z"), (1, "a b\nc", 6, "y"), (None, "a b", 7, "x")] + [(i, "a b\nd", 0, "w") for i in range(2, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_DROPPED int, leaf string")
    got = drop_recurring_lines(df)
    assert got.columns == ["doc_id", "text", "leaf", "n_lines", "n_dropped"]
    found = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert found == [(0, "a b"), (1, "c"), (1, "c"), (2, "d")] + [(i, "") for i in range(3, 8)]
    assert drop_recurring_lines(df.limit(0)).collect() == []


def test_distinct_short_lines_and_number_rows_survive(spark, docs_of):
    texts = [f"It is a k{chr(97 + i)} l{chr(97 + i)} m{chr(97 + i)}\n{i} {i * 7} {i * 3}\n0 0 0 0 {i}\n0 0 0 0 {i}\n<*> {i}\n5 5 5\nPage {i} of 9" for i in range(8)]
    got = {r.doc_id: r.text for r in drop_recurring_lines(docs_of(texts).repartition(3)).collect()}
    assert got[0] == texts[0]
    # Equal rows of numbers and a page line's template recur; unlike rows and wordings do not.
    assert all(got[i] == "\n".join(texts[i].split("\n")[:5]) for i in range(1, 8))
