"""Small programs with known answers, compared as bags."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from ruleloom import Program, ProgramError
from ruleloom.lang.ast import Atom, Call, In, Neg, Unify, Var
from ruleloom.lang.parser import parse


def plain(v):
    if isinstance(v, Row):
        return tuple(plain(x) for x in v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def rows(spark, text, name="Out", **more):
    df = Program(text, spark, **more).df(name)
    return sorted((plain(tuple(r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


def bag(*expected):
    return sorted(expected, key=repr)


GRAPH = "Edge(1, 2); Edge(2, 3); Edge(3, 4); Edge(6, 7);"


def test_parse_shapes():
    rule = parse("P(x, y: 2 * z) :- Q(x, z), ~R(z), x in [1, 2], z == 3")[0]
    assert [f.name for f in rule.fields] == [0, "y"]
    assert isinstance(rule.body.parts[0], Atom) and isinstance(rule.body.parts[1], Neg)
    assert isinstance(rule.body.parts[2], In) and isinstance(rule.body.parts[3], Unify)
    e = parse("P(1 + 2 * 3 - 4)")[0].fields[0].value
    assert e.name == "+" and e.args[1][1].name == "-"
    arrow = parse('P(x) :- a -> b == "k" -> x')[0].body
    assert arrow.left == Call("->", ((0, Var("a")), (1, Var("b"))))


@pytest.mark.parametrize("text", ["P(x :- Q(x)", "P(x) :- ", "P(a? += 1) :- Q(a)", '"x"', "P(x) :- Q(x) R(x)"])
def test_parse_errors(text):
    with pytest.raises(ProgramError):
        parse(text)


CASES = {
    "projection": ("Out(x + 1, name: y) :- T(x, y); T(1, \"a\"); T(2, \"b\");", [(2, "a"), (3, "b")]),
    "filter": ("Out(x) :- T(x), x > 1, x != 3; T(1); T(2); T(3);", [(2,)]),
    "zero_arguments": ("Out() :- T(x), x > 1; T(1); T(2);", [("yes",)]),
    "function_value": ("F(x) = 2 * x; Out(F(3), F(F(1)));", [(6, 4)]),
    "function_of_table": ("F(1) = 10; F(2) = 20; T(1); T(2); T(3); Out(x, F(x)) :- T(x);", [(1, 10), (2, 20)]),
    "rest_of": ("T(a: 1, b: 2, c: 3); Out(a: 2 * a, ..r) :- T(a:, b:, ..r);", [(2, 3)]),
    "rest_as_record": ("T(a: 1, b: 2); Out(x: r.b) :- T(a:, ..r);", [(2,)]),
    "record": ('Out(r.x, r.y.z) :- r == {x: 1, y: {z: "a"}};', [(1, "a")]),
    "destructuring": ("Out(a, c) :- {a:, b: {c:}} == {a: 1, b: {c: 2}};", [(1, 2)]),
    "arrow": ('Out(v) :- 2 -> v in [1 -> "a", 2 -> "b"];', [("b",)]),
    "index": ("Out(xs[1], xs[7]) :- xs == [5, 6];", [(6, None)]),
    "condition": ('Out(x, if x > 1 then "big" else "small") :- x in [1, 2];', [(1, "small"), (2, "big")]),
    "null_tests": ("T(1, null); T(2, 5); Out(x) :- T(x, y), y is null; Out(x) :- T(x, y), y is not null, y > 9;", [(1,)]),
    "predicate_literal": ("Out(p.predicate_name) :- p == Edge;", [("Edge",)]),
    "join": ("Out(a, c) :- Edge(a, b), Edge(b, c);" + GRAPH, [(1, 3), (2, 4)]),
    "theta_join": ("A(1); A(5); B(3); B(4); Out(a, b) :- A(a), B(b), a < b;", [(1, 3), (1, 4)]),
    "cross_join": ("A(1); A(2); B(3); Out(a, b) :- A(a), B(b);", [(1, 3), (2, 3)]),
    "null_never_joins": ("A(null); A(1); B(null); B(1); Out(x) :- A(x), B(x);", [(1,)]),
    "repeated_variable": ("A(1, 1); A(1, 2); Out(x) :- A(x, x);", [(1,)]),
    "expression_argument": ("A(1); A(2); B(2); B(3); Out(x) :- A(x), B(x + 1);", [(1,), (2,)]),
    "anti_join": ("Out(a) :- Edge(a, b), ~Edge(b, c);" + GRAPH, [(3,), (6,)]),
    "negated_conjunction": ("Out(x) :- x in [1, 2, 3], ~(Edge(x, y), y > 2);" + GRAPH, [(1,)]),
    "negation_without_variables": ("A(1); Out(x) :- x in [5], ~A(2); Out(x) :- x in [6], ~A(1);", [(5,)]),
    "implication": ('B("a"); B("p"); F("a"); D("d"); F("d"); Out(x) :- x in ["a", "p", "d"], (B(x) => F(x));', [("a",), ("d",)]),
    "existence_value": ("Out(x, ~Edge(x, y), !~Edge(x, y)) :- x in [1, 4];" + GRAPH, [(1, False, True), (4, True, False)]),
    "bag_union": ("Out(1); Out(1); Out(x) :- x in [1, 2];", [(1,), (1,), (1,), (2,)]),
    "disjunction_keeps_duplicates": ("Out(x) :- x in [1, 2, 3], (x > 1 | x < 3);", [(1,), (2,), (2,), (3,)]),
    "distinct": ("Out(x) distinct :- x in [1, 1, 2]; Out(x) distinct :- x in [2];", [(1,), (2,)]),
    "group_by": ("S(k, n? += v) distinct :- T(k, v); T(1, 2); T(1, 3); T(2, 4); Out(k, n) :- S(k, n:);", [(1, 5), (2, 4)]),
    "value_aggregation": ("S(k) Max= v :- T(k, v); T(1, 2); T(1, 3); Out(k, S(k)) :- T(k, v), v < 3;", [(1, 3)]),
    "global_aggregate": ("T(1); S() += x :- T(x), x > 5; Out(S());", [(None,)]),
    "multi_body": ("S(k) += v :- A(k, v); S(k) += 10 * v :- B(k, v); A(1, 1); B(1, 2); B(2, 3); Out(k, v) :- S(k) == v;", [(1, 21), (2, 30)]),
    "count_is_distinct": ("Out() Count= x :- x in [1, 1, 2];", [(2,)]),
    "list_keeps_null": ("T(1); T(null); Out(Size(xs)) :- xs List= (x :- T(x));", [(2,)]),
    "empty_list_is_null": ("T(1); Out(xs) :- xs List= (x :- T(x), x > 1);", [(None,)]),
    "count_of_nothing": ("T(1); Out(a, n) :- a in [1, 2], n Count= (x :- T(x), x > a);", [(1, 0), (2, 0)]),
    "set_is_sorted": ("Out(s) :- s Set= (x :- x in [3, 1, 3]);", [([1, 3],)]),
    "array": ("Out(a) :- a Array= (0 - x -> x :- x in [1, 3, 2]);", [([3, 2, 1],)]),
    "argmin_argmax": ("T(\"a\", 5); T(\"b\", 7); Out(ArgMin{n -> v :- T(n, v)}, ArgMax{n -> v :- T(n, v)});", [("a", "b")]),
    "argmax_k": ("Top(x) = ArgMaxK(x, 2); T(\"a\", 5); T(\"b\", 7); T(\"c\", 6); Out(Top{n -> v :- T(n, v)});", [(["b", "c"],)]),
    "user_aggregation": ("C(x) = Count(x) * 10; T(1, 1); T(1, 2); T(1, 2); Out(k, n? C= v) distinct :- T(k, v);", [(1, 20)]),
    "semigroup": ('J(a, b) --> a ++ "-" ++ b; @BareAggregation(Chain, semigroup: J); Out(x) :- x Chain= (s :- s in ["p", "q"]);', [("p-q",)]),
    "left_outer_combine": ("Out(x, y) :- x in [1, 9], y Min= (b :- Edge(x, b));" + GRAPH, [(1, 2), (9, None)]),
    "full_outer_merge": ("A(1, 5); B(2, 6); Out(k:, a? ++= [v], b? ++= []) distinct :- A(k, v); Out(k:, a? ++= [], b? ++= [v]) distinct :- B(k, v);", [([5], [], 1), ([], [6], 2)]),
    "combine_null_key": ("A(null); A(1); B(null, 5); B(1, 6); Out(x, m) :- A(x), m Max= (v :- B(x, v));", [(None, None), (1, 6)]),
    "combine_filtered": ("A(1); A(2); B(1, 5); B(1, 7); B(2, 9); Out(x, m) :- A(x), m += (w :- B(x, v), v > 5, w == 2 * v);", [(1, 14), (2, 18)]),
    "combine_inequality": ("A(1); A(3); B(1); B(2); B(3); Out(a, n) :- A(a), n += (1 :- B(b), b <= a);", [(1, 1), (3, 3)]),
    "nested_combine": ("G(1, 10); G(1, 20); G(2, 30); Out(x) :- x Max= (s :- G(k, v), s == (combine += w :- G(k, w)));", [(30,)]),
    "list_combine": ("T([1, 2, 3]); T([]); Out(s) :- T(xs), s += (2 * x :- x in xs, x > 1);", [(10,), (None,)]),
    "as_of": ('P("a", 1, 10); P("a", 5, 50); T("a", 4); T("a", 6); Out(t, v) :- T(s, t), v ArgMax= (p -> u :- P(s, u, p), u <= t);', [(4, 10), (6, 50)]),
    "window": ("D(\"p\", 1, 5); D(\"p\", 2, 6); D(\"q\", 1, 7); Out(k, x) Aggr= CumulativeSum(v, [k], [x]) :- D(k, x, v);", [("p", 1, 5), ("p", 2, 11), ("q", 1, 7)]),
    "functor": ("Big(x) :- Src(x), x > Least_(); Least_() = 1; S1(1); S1(2); S2(5); S2(7); Out := Big(Src: S2, Least_: Five); Five() = 5;", [(7,)]),
    "functor_constant": ("Big(x) :- S(x), x > Low(); Low() = 0; S(1); S(9); Out := Big(Low: 4);", [(9,)]),
    "inline_rule": ("Near(x, y) :- Abs(x - y) < 2; Out(x, y) :- x in [1, 5], y in [2, 9], Near(x, y);", [(1, 2)]),
    "udf": ("F(x) --> x * x; Out(F(4));", [(16,)]),
    "order_and_limit": ('T(3); T(1); T(2); Out(x) order_by("col0 desc") limit(2) :- T(x);', [(3,), (2,)]),
    "membership_filter": ("Out(x) :- x in [1, 2, 3], Constraint(x in [2, 3, 3]);", [(2,), (3,)]),
    "sql_expression": ('Out(SqlExpr("upper({s})", {s: "a" ++ "b"}), SqlExpr("1 + 1", {}));', [("AB", 2)]),
    "cast_json": ("Out(r.a, Size(r.b)) :- r == Cast('{\"a\": 1, \"b\": [1, 2]}', {a: Num, b: [Num]});", [(1.0, 2)]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    text, expected = CASES[name]
    assert rows(spark, text) == bag(*expected)


def test_closure_to_fixpoint(spark):
    text = GRAPH + "@Recursive(C, -1); C(x, y) distinct :- Edge(x, y); C(x, z) distinct :- C(x, y), Edge(y, z); Out(x, y) :- C(x, y);"
    assert rows(spark, text) == bag((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7))


def test_closure_of_a_cycle_both_ways(spark):
    cycle = "Edge(1, 2); Edge(2, 3); Edge(3, 1);"
    linear = "C(x, y) distinct :- Edge(x, y); C(x, z) distinct :- C(x, y), Edge(y, z);"
    doubling = "C(x, y) distinct :- Edge(x, y); C(x, z) distinct :- C(x, y), C(y, z);"
    assert rows(spark, cycle + linear, "C") == rows(spark, cycle + doubling, "C") == bag(*[(a, b) for a in (1, 2, 3) for b in (1, 2, 3)])


def test_bounded_depth(spark):
    chain = "".join(f"Edge({i}, {i + 1});" for i in range(8))
    text = chain + "@Recursive(C, 2); C(x, y) distinct :- Edge(x, y); C(x, z) distinct :- C(x, y), Edge(y, z);"
    assert max(b - a for a, b in rows(spark, text, "C")) == 3


def test_shortest_distance(spark):
    text = "Edge(1, 2, 7); Edge(2, 3, 1); Edge(1, 3, 9); @Recursive(D, -1); D(x, y) Min= w :- Edge(x, y, w); D(x, z) Min= D(x, y) + w :- Edge(y, z, w); Out(x, y, d) :- D(x, y) == d;"
    assert rows(spark, text) == bag((1, 2, 7), (1, 3, 8), (2, 3, 1))


def test_mutual_recursion_on_a_grid(spark):
    steps = "Step(x, y) distinct :- x in Range(9), y in [x + 2, x * 2], y < 9, y > x;"
    text = steps + "@Recursive(Black, -1); Black(x) distinct :- x in [1]; White(y) distinct :- Black(x), Step(x, y); Black(y) distinct :- White(x), Step(x, y); Out(x) :- White(x);"
    black, white = {1}, set()
    for _ in range(9):
        white |= {y for x in black for y in (x + 2, x * 2) if x < y < 9}
        black |= {y for x in white for y in (x + 2, x * 2) if x < y < 9}
    assert rows(spark, text) == bag(*[(x,) for x in white])


def test_game_by_recursion_through_negation(spark):
    """A token on a number may be lowered by 2 or 5; who can't move loses."""
    text = "Cell(x) distinct :- x in Range(13); Go(x, y) distinct :- Cell(x), y in [x - 2, x - 5], y >= 0; @Recursive(Good, -1); Good(x) distinct :- Go(x, y), ~Good(y); Out(x) :- Good(x);"
    good: set = set()
    for x in range(13):
        if any(y >= 0 and y not in good for y in (x - 2, x - 5)):
            good.add(x)
    assert rows(spark, text) == bag(*[(x,) for x in good])


def test_stop_once_a_sum_is_reached(spark):
    t = spark.createDataFrame([(i, i + 1, 10 * i) for i in range(1, 9)], "a long, b long, w long")
    text = "@Recursive(Seen, -1, stop: Full); Seen(x) distinct :- x in [1]; Seen(b) distinct :- Seen(a), t(a:, b:); Full() :- s += (w :- Seen(a), t(a:, b:, w:)), s > 55; Out(x) :- Seen(x);"
    assert rows(spark, text, tables={"t": t}) == bag((1,), (2,), (3,))


def test_flags_and_tables(spark):
    text = '@DefineFlag("low", "2"); Out(x) :- t(x:), x > ${low};'
    t = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x long")
    assert rows(spark, text, tables={"t": t}) == bag((3,), (4,))
    assert rows(spark, text, tables={"t": t}, flags={"low": "3"}) == [(4,)]
    assert rows(spark, '@DefineFlag("f", "a"); Out(FlagValue("f"));', flags={"f": "b"}) == [("b",)]


def test_files_and_sql_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert rows(spark, f'Out(a, b) :- `("{tmp_path}/t.csv")`(a:, b:);') == bag((1, "x"), (2, "y"))
    assert rows(spark, "Out(x) :- `((select 5 as x))`(x:);") == [(5,)]
    program = Program("P(1); P(2);", spark)
    program.csv("P", f"{tmp_path}/out.csv")
    assert spark.read.csv(f"{tmp_path}/out.csv", header=True).count() == 2


def test_import(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "m.l").write_text("Twice(x) = H(x) * 2; H(x) = x; Data(1); Data(2);")
    text = "import lib.m.Twice; import lib.m.Data as D; Out(Twice(x)) :- D(x);"
    assert rows(spark, text, roots=[str(tmp_path)]) == bag((2,), (4,))
    assert rows(spark, text + "Name(p.predicate_name) :- p == D;", "Name", roots=[str(tmp_path)]) == [("Data",)]
    (tmp_path / "lib" / "n.l").write_text("import lib.n.X; X(1);")
    with pytest.raises(ProgramError):
        Program("import lib.n.X; Out(x) :- X(x);", spark, roots=[str(tmp_path)])
    with pytest.raises(ProgramError):
        Program("import lib.none.X; Out(x) :- X(x);", spark, roots=[str(tmp_path)])


def test_ground_and_text_table(spark):
    program = Program('@Ground(P); P("a", 1); P("b", 10); Out(x, y) :- P(x, y); @OrderBy(Out, "col1");', spark)
    assert program.text("Out").splitlines()[3:5] == ["| a    |    1 |", "| b    |   10 |"]


@pytest.mark.parametrize(
    "text",
    [
        "Out(x) :- Missing(x);",
        "Out(x) :- T(y); T(1);",
        "Out(x) :- T(z: x); T(1);",
        "Out(1); Out(a: 2);",
        "Out(1) distinct; Out(2);",
        "@Nonsense(Out); Out(1);",
        "@Limit(Out, 1); @Limit(Out, 2); Out(1);",
        "Out(x) :- Out(x);",
    ],
)
def test_program_errors(spark, text):
    with pytest.raises(ProgramError):
        Program(text, spark).df("Out").collect()


def test_sweeps_in_turn_and_together(spark):
    text = '@Recursive(A, 10, mode: "%s"); A() Max= 0; B() Max= A() + 1; C() Max= B() + 1; A() Max= C() + 1; Out(A());'
    assert rows(spark, text % "diamond") == [(30,)]
    assert rows(spark, text % "horizontal") == [(9,)]


def test_command_line(spark, tmp_path, capsys):
    from ruleloom.__main__ import main

    (tmp_path / "p.l").write_text('P("a", 1); P("b", ${n});')
    assert main([f"{tmp_path}/p.l", "run", "P", "--n=5"]) == 0
    assert "| b    |    5 |" in capsys.readouterr().out
    assert main(["x"]) == 2
