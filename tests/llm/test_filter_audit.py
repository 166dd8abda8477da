"""The audit against filters that are applied one after the other."""

import re
from itertools import permutations

from sedgewren.llm import filter_audit

TEXT = "doc_id long, text string, source string, n int, good int, mask int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def slow(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    failing = []
    for i, t, _ in texts:
        failing.append(fails(t) | {"E": any(u == t and j is not None and i is not None and j < i for j, u, _ in texts)})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, total = {}, {}
    for part in {s for *_, s in texts}:
        own = [k for k, row in enumerate(texts) if row[2] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if failing[k][letter]]
                before = [k for k in own if k not in set(left)]
                left = [k for k in left if not failing[k][letter]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(failing[k][letter] for k in before), sum(failing[k][letter] and sum(failing[k].values()) == 1 for k in own),
                    sum(texts[k][0] in good for k in gone), sum(texts[k][0] in toxic for k in gone), letter,
                ]
                total[part, letter] = total.get((part, letter), 0) + len(gone)
    return {key: (*value[:6], total[key[0], value[6]]) for key, value in out.items()}


def rows():
    words = [f"w{i}" for i in range(80)]
    plain, few, many = " ".join(words), "Few words", " ".join(words[:30] * 3)
    out = [(1, plain, "a"), (2, plain, "b"), (3, few, "a"), (4, many, "a"), (5, plain.upper(), "a"), (6, plain + " #", "b"), (7, few + " $", None), (8, few, ""), (9, None, "a"), (10, "", "a")]
    out += [(11, " \t\n\x0b\x0c\r ", "a"), (12, "a\xa0b c", "a"), (13, "É" * 10 + "A", "b"), (14, many.upper() + "%", "b"), (1, plain, "a"), (3, few, "a"), (None, plain, "a"), (None, "only null", "a")]
    return out + [(i, few, "hot") for i in range(20, 60)] + [(15, "long word " * 60_000, "a")]


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, 1), (5, 1, None), (14, 1, 1), (14, 0, 0), (None, 1, 1), (25, 1, 1), (999, 1, 1)]


def test_audit_equals_filters_in_turn(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows()], TEXT).repartition(4)
    found = filter_audit.filter_audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(found) == len(got) == 600 * 4 and got == slow(rows(), LABELS)


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], TEXT), labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, 1, 1, 1)], TEXT), labels)
    assert one.count() == 600 and one.where("part <> '' OR good_lost + toxic_lost > 0").count() == 0


def test_survivors_of_two_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5), ("p", 1, 3), ("p", 2, 2), ("p", 3, 1)], "part string, mask int, n long")
    assert filter_audit.survivors(counts, 2, ["n"]).first().n == [11, 7, 8, 5]
