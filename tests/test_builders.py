from tidemark.operators import builders as b

CODE = """
package p; import q.R;
class Outer {
  int f = make(1);
  Outer(int n) { this.n = n; }
  static class Inner {
    int sum(List<String> xs, int limit) throws E, F {
      int total = 0; // a comment { with braces
      for (String x : xs) {
        if (x == null) continue;
        total += size(x);
        if (total > limit) break;
      }
      String s = "} not a brace";
      return total;
    }
  }
  abstract void none();
}
"""


def graph(body, params=""):
    (m,) = b.methods(f"class A {{ void m({params}) {{ {body} }} }}")
    g = b.Graphs(m)
    name = lambda i: {0: "in", 1: "out"}.get(i, f"{g.nodes[i].kind}:{' '.join(t[1] for t in g.nodes[i].tokens)}")
    return g, name


def flow(body, params=""):
    g, name = graph(body, params)
    return {(name(a), name(c), label) for a, c, label in g.flow_edges}


def test_methods_and_innermost_class():
    assert [(m.cls, m.name) for m in b.methods(CODE)] == [("Outer", "Outer"), ("Inner", "sum")]
    assert [m.name for m in b.methods("a = 1; b(a);")] == ["<top>"]
    assert b.methods("") == [] and b.methods("// only a comment") == []


def test_flow_of_branches_and_loops():
    assert flow("if (a) b(); else c(); d();") == {
        ("in", "if:a", ""), ("if:a", "expression:b ( )", "true"), ("if:a", "expression:c ( )", "false"),
        ("expression:b ( )", "expression:d ( )", ""), ("expression:c ( )", "expression:d ( )", ""), ("expression:d ( )", "out", ""),
    }
    assert flow("while (a) { if (b) break; if (c) continue; d(); }") == {
        ("in", "while:a", ""), ("while:a", "if:b", "true"), ("if:b", "break:", "true"), ("if:b", "if:c", "false"), ("if:c", "continue:", "true"), ("continue:", "while:a", "continue"),
        ("if:c", "expression:d ( )", "false"), ("expression:d ( )", "while:a", "back"), ("while:a", "out", "false"), ("break:", "out", "break"),
    }
    assert flow("do { a(); } while (b);") == {("in", "expression:a ( )", ""), ("expression:a ( )", "do:b", ""), ("do:b", "expression:a ( )", "true"), ("do:b", "out", "false")}


def test_flow_of_switch_try_and_unreachable_tail():
    assert flow("switch (x) { case 1: a(); case 2: b(); break; }") == {
        ("in", "switch:x", ""), ("switch:x", "expression:a ( )", "1"), ("switch:x", "expression:b ( )", "2"), ("expression:a ( )", "expression:b ( )", ""),
        ("expression:b ( )", "break:", ""), ("break:", "out", "break"), ("switch:x", "out", "no case"),
    }
    e = flow("try { throw x; } catch (E e) { a(); } finally { z(); } return; dead();")
    assert ("throw:x", "catch:E e", "throw") in e and ("expression:a ( )", "expression:z ( )", "") in e and ("return:", "out", "return") in e
    assert not any("dead" in a or "dead" in c for a, c, _ in e)


def test_data_edges_follow_reaching_definitions():
    g, name = graph("int y = x; while (y > 0) { y = y - 1; } use(y);", "int x")
    got = {(name(a), name(c), v) for a, c, v in g.data_edges()}
    assert got == {
        ("in", "expression:int y = x", "x"), ("expression:int y = x", "while:y > 0", "y"), ("expression:int y = x", "expression:y = y - 1", "y"), ("expression:int y = x", "expression:use ( y )", "y"),
        ("expression:y = y - 1", "while:y > 0", "y"), ("expression:y = y - 1", "expression:y = y - 1", "y"), ("expression:y = y - 1", "expression:use ( y )", "y"),
    }


def test_dependence_on_conditions():
    g, name = graph("if (a) { b(); } c();")
    assert {(name(a), name(c)) for a, c, _ in g.control_edges()} == {("in", "if:a"), ("if:a", "expression:b ( )"), ("in", "expression:c ( )")}


def test_odd_texts(spark):
    texts = ["{" * 5000, "}" * 5000, "if (", "for (;;) {", "((((", '"open', "/* open", "switch (x) {", "a = 1;" * 3000, "", None, CODE]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file int, text string")
    rows = b.build_graphs(df).collect()
    assert {r["file"] for r in rows} >= {8, 11} and not {r["file"] for r in rows} & {9, 10}
    stats = {(r["file"], r["method"].split("@")[0], r["layer"]): r for r in b.method_statistics(b.build_graphs(df)).collect()}
    assert stats[11, "sum", "cfg"]["cyclomatic"] == 4
    assert stats[8, "<top>", "seq"]["n_edges"] == 2999
    assert [r["name"] for r in b.build_calls(df.where("file = 11")).collect()] == ["size"]
