"""Def-use edges and graph input."""

from kinsift.functions.dataflow import DataflowEdges, extract, graph_input


def named(source):
    words, edges = extract(source)
    return [(words[i], relation, [words[s] for s in sources], sources) for i, _, relation, sources in edges]


def test_assignment_points_at_its_right_side():
    words, edges = extract("a = 1\nb = a + a\n")
    assert edges[0] == (0, "a", "computedFrom", [])
    assert edges[-1][:3] == (3, "b", "computedFrom") and edges[-1][3] == [5, 7]
    assert [e[3] for e in edges if e[0] in (5, 7)] == [[0], [0]]


def test_augmented_assignment_adds_the_former_value_first():
    words, edges = extract("x = 1\ny = 2\nx += y\n")
    last = edges[-1]
    assert last[1:3] == ("x", "computedFrom") and last[3] == [0, 8]


def test_matrix_product_update_is_a_read():
    assert all(e[2] == "comesFrom" for e in extract("x @= y\n")[1])


def test_other_targets_are_reads():
    for source in ("a, b = c\n", "a[i] = c\n", "a.b = c\n"):
        assert all(e[2] == "comesFrom" for e in extract(source)[1])


def test_loops_and_functions():
    words, edges = extract("def f(n, m=1):\n    for i in range(n):\n        s = i\n    return s\n")
    by = {}
    for i, name, relation, sources in edges:
        by.setdefault(name, []).append((relation, sources))
    assert by["n"][0] == ("comesFrom", []) and by["n"][1][1] != []
    assert by["i"][0][0] == "comesFrom" and len(by["i"][0][1]) == 2  # range and n
    assert by["s"][0][0] == "computedFrom" and by["s"][1][1]
    assert extract("for i, x in enumerate(y):\n    pass\n")[1][-1][2] == "comesFrom"


def test_chained_annotated_and_broken():
    assert [e[1] for e in extract("a = b = c\n")[1]] == ["c", "b", "a"]
    assert extract("x: int = y\n")[1][1][:3] == (0, "x", "computedFrom")
    assert all(e[2] == "comesFrom" for e in extract("x: int\n")[1])
    assert extract("x = = 1") == (["x", "=", "=", "1"], [])
    assert extract("é = 'ü'; b = é\n")[1][-1][3] == [6]


def test_table_function(spark):
    spark.udtf.register("dataflow_edges", DataflowEdges)
    rows = spark.sql("SELECT * FROM dataflow_edges('a = b')").collect()
    assert [(r.name, r.relation) for r in rows] == [("b", "comesFrom"), ("a", "computedFrom")]


class Stub:
    unk_token, unk_token_id, cls_token_id, sep_token_id = "?", 9, 1, 2

    def tokenize(self, word):
        return list(word)

    def convert_tokens_to_ids(self, words):
        return [10 + len(w) for w in words]


def test_graph_input():
    words, edges = extract("ab = c\n")
    out = graph_input(Stub(), words, edges)
    assert out["input_ids"] == [1, 11, 11, 11, 11, 2, 9, 9]
    assert out["position_idx"] == [0, 1, 2, 3, 4, 5, 0, 0] and out["code_block"] == 6
    # slot 6 is c (position 4), slot 7 is ab (1, 2) and comes from c
    assert {(4, 6), (6, 6), (1, 7), (2, 7), (6, 7), (7, 7)} == set(out["attention"])
    assert out["pooling"] == [False, True, True, True, True, False, False, False]
    short = graph_input(Stub(), words, edges, code_length=2)
    assert len(short["input_ids"]) == 4 + 1  # c is cut off, ab stays
