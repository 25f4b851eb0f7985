from ruleloom.builder import P, agg, rules, variables


def test_rules_from_python(spark):
    x, y, z, n = variables("x y z n")
    with rules() as r:
        P.Parent("a", "b").fact()
        P.Parent("b", 'c"d').fact()
        P.Grand(x, z) << (P.Parent(x, y), P.Parent(y, z))
        P.Out(child=z, n=agg("Sum", n * 2)) << (P.Grand(x, z), n.isin([1, 2]), ~P.Parent(z, x))
    assert [tuple(v) for v in r.program(spark).df("Out").collect()] == [('c"d', 6)]
    assert "Grand(x, z) :- Parent(x, y), Parent(y, z);" in r.text
