"""Queries of the rule language over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleloom import Program

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (rules that define Q, SQL)
QUERIES: dict[str, tuple[str, str]] = {}


def query(name: str, rules: str, sql: str) -> None:
    QUERIES[name] = (rules, sql)


query(
    "q1_group_agg",
    """A(flag:, status:, qty? += q, price? += p, disc? Avg= d, n? += 1) distinct :- lineitem(l_returnflag: flag, l_linestatus: status, l_quantity: q, l_extendedprice: p, l_discount: d);
    Q(flag:, status:, sum_qty: qty, sum_price: Round(price, 1), avg_disc: Round(disc, 5), n:) :- A(flag:, status:, qty:, price:, disc:, n:);""",
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 1) AS sum_price, round(avg(l_discount), 5) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL",
)
query(
    "filter_project",
    'Q(key: k, size: if p > 200000.0 then "big" else if p > 50000.0 then "middle" else "small", half: p / 2) :- orders(o_orderkey: k, o_totalprice: p, o_orderstatus: s), s != "F", p >= 1000.0;',
    "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 1000",
)
query(
    "inner_join_chain",
    "Q(region:, n? += 1) distinct :- orders(o_custkey: c), customer(c_custkey: c, c_nationkey: k), nation(n_nationkey: k, n_regionkey: r), region(r_regionkey: r, r_name: region);",
    "SELECT r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
query("theta_join", "Q(a:, b:) :- nation(n_nationkey: x, n_name: a), region(r_regionkey: y, r_name: b), x < y;", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_nationkey < r_regionkey")
query("cross_join", "Q(a:, b:) :- region(r_name: a), region(r_name: b);", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y")
query("self_join", "Q(a:, b:) :- supplier(s_suppkey: a, s_nationkey: n), supplier(s_suppkey: b, s_nationkey: n), a < b;", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
query(
    "value_join",
    "Segment(c) = s :- customer(c_custkey: c, c_mktsegment: s); Q(segment: Segment(c), n? += 1) distinct :- orders(o_custkey: c);",
    "SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
)
query("anti_join", "Q(c:) :- customer(c_custkey: c), ~orders(o_custkey: c);", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
query("semi_join", "Big(c) distinct :- orders(o_custkey: c, o_totalprice: p), p > 400000.0; Q(c:, name:) :- customer(c_custkey: c, c_name: name), Constraint(!~Big(c));", "SELECT c_custkey AS c, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
query(
    "implication",
    "Q(c:) :- customer(c_custkey: c), (orders(o_custkey: c, o_totalprice: p) => Constraint(p > 30000.0));",
    "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 30000))",
)
query("existence_value", "Q(c:, has: !~orders(o_custkey: c)) :- customer(c_custkey: c);", "SELECT c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer")
query("left_outer_combine", "Q(c:, least:) :- customer(c_custkey: c), least Min= (p :- orders(o_custkey: c, o_totalprice: p));", "SELECT c_custkey AS c, min(o_totalprice) AS least FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
query(
    "full_outer_merge",
    "Q(nation:, customers? += 1, suppliers? += 0) distinct :- customer(c_nationkey: nation, c_acctbal: b), b > 9000.0; Q(nation:, customers? += 0, suppliers? += 1) distinct :- supplier(s_nationkey: nation);",
    "SELECT coalesce(c, s) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS c, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS s, count(*) AS suppliers FROM supplier GROUP BY 1) ON c = s",
)
query("union_all", "Q(n:, b:) :- customer(c_nationkey: n, c_acctbal: b), b < 0.0; Q(n:, b:) :- supplier(s_nationkey: n, s_acctbal: b);", "SELECT c_nationkey AS n, c_acctbal AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
query("union_distinct", "Q(n:) distinct :- customer(c_nationkey: n); Q(n:) distinct :- supplier(s_nationkey: n);", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
query("disjunction", "Q(p:) :- part(p_partkey: p, p_size: s, p_retailprice: r), (s > 40 | r < 1000.0);", "SELECT p_partkey AS p FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey FROM part WHERE p_retailprice < 1000")
query("intersect_like", "Q(n:) distinct :- customer(c_nationkey: n, c_acctbal: b), b > 9500.0, supplier(s_nationkey: n);", "SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier")
query("except_like", "Rich(n) distinct :- supplier(s_nationkey: n, s_acctbal: b), b > 5000.0; Q(n:) distinct :- nation(n_nationkey: n), ~Rich(n);", "SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
query("multi_body_agg", "Q(k:, n? += 1) distinct :- orders(o_orderkey: k); Q(k:, n? += 10) distinct :- lineitem(l_orderkey: k);", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT o_orderkey AS k, 1 AS n FROM orders UNION ALL SELECT l_orderkey, 10 FROM lineitem) GROUP BY k")
query("global_agg", "Q(n? += 1, most? Max= p) distinct :- orders(o_totalprice: p), p < 0.0;", "SELECT sum(1)::BIGINT AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice < 0")
query("count_distinct", "Q(kind:, users? Count= u) distinct :- events(event_type: kind, user_id: u);", "SELECT event_type AS kind, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
query("set_agg", "Q(u:, kinds? Set= k) distinct :- events(event_type: k, user_id: u);", "SELECT user_id AS u, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY ALL")
query("list_sorted", "Q(u:, ids? Array= e -> e) distinct :- events(event_id: e, user_id: u);", "SELECT user_id AS u, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL")
query("argmax", "Q(brand:, dear? ArgMax= p -> r * 1000000.0 + p) distinct :- part(p_brand: brand, p_partkey: p, p_retailprice: r);", "SELECT p_brand AS brand, arg_max(p_partkey, p_retailprice * 1000000.0 + p_partkey) AS dear FROM part GROUP BY ALL")
query(
    "argmax_k",
    "Top3(x) = ArgMaxK(x, 3); Q(brand:, dear? Top3= p -> {r:, p:}) distinct :- part(p_brand: brand, p_partkey: p, p_retailprice: r);",
    "SELECT p_brand AS brand, list(p_partkey ORDER BY p_retailprice DESC, p_partkey DESC)[1:3] AS dear FROM part GROUP BY ALL",
)
query("argmin_k", "Low2(x) = ArgMinK(x, 2); Q(brand:, cheap? Low2= p -> {r:, p:}) distinct :- part(p_brand: brand, p_partkey: p, p_retailprice: r);", "SELECT p_brand AS brand, list(p_partkey ORDER BY p_retailprice, p_partkey)[1:2] AS cheap FROM part GROUP BY ALL")
query("median", "Q(brand:, middle? Median= s) distinct :- part(p_brand: brand, p_size: s);", "SELECT p_brand AS brand, median(p_size)::DOUBLE AS middle FROM part GROUP BY ALL")
query(
    "string_agg",
    'Names(r) Array= n -> n :- nation(n_regionkey: r, n_name: n); Q(region: r, names: Join(Names(r), ", ")) :- region(r_regionkey: r);',
    "SELECT n_regionkey AS region, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY ALL",
)
query("logical_aggs", "Q(brand:, every? LogicalAnd= s > 2, some? LogicalOr= s > 49, n? Countif= s > 25) distinct :- part(p_brand: brand, p_size: s);", "SELECT p_brand AS brand, bool_and(p_size > 2) AS every, bool_or(p_size > 49) AS some, count_if(p_size > 25)::BIGINT AS n FROM part GROUP BY ALL")
query("statistics", "A(f:, v? VarPop= q, s? StddevSamp= q) distinct :- lineitem(l_returnflag: f, l_quantity: q); Q(f:, v: Round(v, 6), s: Round(s, 6)) :- A(f:, v:, s:);", "SELECT l_returnflag AS f, round(var_pop(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
query("user_agg", "Spread(x) = Max(x) - Min(x); Q(f:, spread? Spread= q) distinct :- lineitem(l_returnflag: f, l_quantity: q);", "SELECT l_returnflag AS f, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY ALL")
query("semigroup_agg", "Longer(a, b) --> (if Length(a) > Length(b) || Length(a) == Length(b) && a < b then a else b); @BareAggregation(Longest, semigroup: Longer); Q(r:, name? Longest= n) distinct :- nation(n_regionkey: r, n_name: n);", "SELECT n_regionkey AS r, arg_min(n_name, (-length(n_name), n_name)) AS name FROM nation GROUP BY ALL")
query("cumulative_sum", "Q(user:, id:, total? Aggr= CumulativeSum(v, [user], [id])) distinct :- events(user_id: user, event_id: id, value: x), v == ToInt64(x * 100);", "SELECT user_id AS user, event_id AS id, sum(trunc(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
query("window_max", "Q(user:, id:, most? Aggr= WindowMax(v, [user], [id], 3)) distinct :- events(user_id: user, event_id: id, value: v);", "SELECT user_id AS user, event_id AS id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS most FROM events")
query("row_number", "Q(user:, id:, n? Aggr= RowNumber([user], [id])) distinct :- events(user_id: user, event_id: id);", "SELECT user_id AS user, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
query("lag", "Q(user:, id:, before? Aggr= Lag(id, [user], [id])) distinct :- events(user_id: user, event_id: id);", "SELECT user_id AS user, event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
query("order_limit", 'Q(k:, p:) order_by("p desc", "k") limit(10) :- orders(o_orderkey: k, o_totalprice: p);', "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10")
query("unnest_split", 'Q(word:, n? += 1) distinct :- part(p_name: t), word in Split(t, " ");', "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL")
query("element_size", 'Q(p:, first: xs[0], n: Size(xs)) :- part(p_partkey: p, p_name: t), xs == Split(t, " ");', "SELECT p_partkey AS p, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' '))::BIGINT AS n FROM part")
query("records", "R(c) = {name:, where: {nation: k}} :- customer(c_custkey: c, c_name: name, c_nationkey: k); Q(c:, name: r.name, nation: r.where.nation) :- R(c) == r;", "SELECT c_custkey AS c, c_name AS name, c_nationkey AS nation FROM customer")
query("rest_of", "Q(key: n_nationkey, ..r) :- nation(n_nationkey:, ..r);", "SELECT n_nationkey AS key, n_name, n_regionkey FROM nation")
query("map_lookup", 'Code(s) = c :- s -> c in ["F" -> 1, "O" -> 2, "P" -> 3]; Q(k:, code: Code(s)) :- orders(o_orderkey: k, o_orderstatus: s);', "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS code FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
query("list_combine", "Q(v:, over:, most:) :- embeddings(vec_id: v, embedding: xs), over Count= (x :- x in xs, x > 0.1), most Max= (x :- x in xs);", "SELECT vec_id AS v, len(list_distinct(list_filter(embedding, lambda x: x > 0.1::DOUBLE)))::BIGINT AS over, list_max(embedding) AS most FROM embeddings")
query(
    "nested_combine",
    "Q(region:, best:) :- region(r_regionkey: r, r_name: region), best Max= (n :- nation(n_nationkey: k, n_regionkey: r), n == (combine += 1 :- customer(c_nationkey: k)));",
    "SELECT r_name AS region, max(n)::BIGINT AS best FROM region LEFT JOIN (SELECT n_regionkey, (SELECT sum(1) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation) ON n_regionkey = r_regionkey GROUP BY ALL",
)
query("as_of", 'Q(id:, last:) :- events(event_id: id, user_id: u, event_type: "purchase"), last Max= (e :- events(event_id: e, user_id: u, event_type: "click"), e < id);', "SELECT p.event_id AS id, max(c.event_id) AS last FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.event_id < p.event_id WHERE p.event_type = 'purchase' GROUP BY ALL")
query("json_field", 'Q(id:, k: ToInt64(JsonExtractScalar(p, "$.k"))) :- events(event_id: id, props: p);', "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
query("date_ops", "Q(k:, days: DateDiffDay(ToDate(s), ToDate(o)), due: ToString(DateAddDay(ToDate(o), 30))) :- orders(o_orderkey: k, o_orderdate: o), lineitem(l_orderkey: k, l_shipdate: s);", "SELECT o_orderkey AS k, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days, (o_orderdate::DATE + 30)::VARCHAR AS due FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
query("time_ops", 'Q(id:, hour: ToString(TimestampTrunc(t, "HOUR")), seconds: Epoch(t)) :- events(event_id: id, ts: t);', "SELECT event_id AS id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, epoch(ts)::DOUBLE AS seconds FROM events")
query("string_fns", 'Q(p:, up: Upper(n), start: Substr(n, 1, 3), at: Strpos(n, "e"), swapped: Replace(n, " ", "_"), long: Length(n), pad: Lpad(b, 12, "*"), like: Like(n, "%a%"), digits: RegexpReplace(b, "[^0-9]", "")) :- part(p_partkey: p, p_name: n, p_brand: b);', "SELECT p_partkey AS p, upper(p_name) AS up, p_name[1:3] AS start, instr(p_name, 'e')::INTEGER AS at, replace(p_name, ' ', '_') AS swapped, length(p_name) AS long, lpad(p_brand, 12, '*') AS pad, p_name LIKE '%a%' AS like, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
query("math_fns", "Q(s:, root: Round(Sqrt(Abs(b)), 6), logged: Round(Log(Abs(b) + 1.0), 6), power: Round(2.0 ^ (k % 7), 3), down: ToInt64(Floor(b)), up: ToInt64(Ceil(b)), sign: Sign(b), least: Least(b, 100.0)) :- supplier(s_suppkey: s, s_acctbal: b, s_nationkey: k);", "SELECT s_suppkey AS s, round(sqrt(abs(s_acctbal)), 6) AS root, round(ln(abs(s_acctbal) + 1.0), 6) AS logged, round(pow(2.0, s_nationkey % 7), 3) AS power, floor(s_acctbal)::BIGINT AS down, ceil(s_acctbal)::BIGINT AS up, sign(s_acctbal)::DOUBLE AS sign, least(s_acctbal, 100.0) AS least FROM supplier")
query("list_fns", "Q(n:, range: Range(n), sorted: Sort([3, n, 1]), unique: Unique([n, 1, n]), text: Join([ToString(n), \"x\"], \"-\"), both: [n] ++ [0], inside: n in [1, 3]) :- nation(n_nationkey: k), n == ToInt64(k);", "SELECT n_nationkey::BIGINT AS n, range(0, n_nationkey::BIGINT) AS range, list_sort([3, n_nationkey::BIGINT, 1]) AS sorted, list_sort(list_distinct([n_nationkey::BIGINT, 1])) AS unique, n_nationkey || '-x' AS text, [n_nationkey::BIGINT, 0] AS both, n_nationkey IN (1, 3) AS inside FROM nation")
query("casts", 'Q(p:, price: ToString(ToInt64(r)), size: ToFloat64(s), bad: TryCast(n, "INT64")) :- part(p_partkey: p, p_retailprice: r, p_size: s, p_name: n);', "SELECT p_partkey AS p, trunc(p_retailprice)::BIGINT::VARCHAR AS price, p_size::DOUBLE AS size, TRY_CAST(p_name AS BIGINT) AS bad FROM part")
query("safe_division", "Q(s:, x: b / (k - 3)) :- supplier(s_suppkey: s, s_acctbal: b, s_nationkey: k);", "SELECT s_suppkey AS s, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal / (s_nationkey - 3) END AS x FROM supplier")
query("functor_filter", 'InSegment(c, b) :- Customers(c, b, Segment()); Segment() = "NONE"; Customers(c, b, s) :- customer(c_custkey: c, c_acctbal: b, c_mktsegment: s); Building := InSegment(Segment: "BUILDING"); Machinery := InSegment(Segment: "MACHINERY"); Q(kind: "b", c:) :- Building(c, b), b > 0.0; Q(kind: "m", c:) :- Machinery(c, b), b < 0.0;', "SELECT 'b' AS kind, c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 UNION ALL SELECT 'm', c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0")
query("flags", '@DefineFlag("least", "40"); Q(k:, q:) :- lineitem(l_orderkey: k, l_quantity: q), q > ${least};', "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity > 40")
query("udf_inline", "Net(price, discount) --> price * (1 - discount); Q(k:, n:, net: Net(p, d)) :- lineitem(l_orderkey: k, l_linenumber: n, l_extendedprice: p, l_discount: d);", "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
query("sql_table", "Q(f:, n:) :- `((select l_returnflag as f, count(*) as n from values ('a'), ('b'), ('a') as t(l_returnflag) group by 1))`(f:, n:);", "SELECT f, count(*) AS n FROM (VALUES ('a'), ('b'), ('a')) t(f) GROUP BY f")
query("sql_expression", 'Q(n:, x: SqlExpr("{a} || \'-\' || cast({b} as string)", {a: name, b: n + 1})) :- nation(n_nationkey: n, n_name: name);', "SELECT n_nationkey AS n, n_name || '-' || (n_nationkey + 1)::VARCHAR AS x FROM nation")

#: Who belongs to whom: every order to its customer, every customer to its nation, every nation to its region.
_EDGES = (
    'Edge(x, y) distinct :- orders(o_orderkey: k, o_custkey: c), x == "order " ++ ToString(k), y == "customer " ++ ToString(c);'
    'Edge(x, y) distinct :- customer(c_custkey: c, c_nationkey: n), x == "customer " ++ ToString(c), y == "nation " ++ ToString(n);'
    'Edge(x, y) distinct :- nation(n_nationkey: n, n_regionkey: r), x == "nation " ++ ToString(n), y == "region " ++ ToString(r);'
)
_EDGES_SQL = (
    "edge AS (SELECT 'order ' || o_orderkey AS x, 'customer ' || o_custkey AS y FROM orders UNION SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer"
    " UNION SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation)"
)
query(
    "closure",
    _EDGES + "@Recursive(C, -1); C(x, y) distinct :- Edge(x, y); C(x, z) distinct :- C(x, y), Edge(y, z); Q(x:, y:) :- C(x, y);",
    f"WITH RECURSIVE {_EDGES_SQL}, c(x, y) AS (SELECT x, y FROM edge UNION SELECT c.x, e.y FROM c JOIN edge e ON c.y = e.x) SELECT x, y FROM c",
)
query(
    "distance",
    _EDGES + "@Recursive(D, -1); D(x, y) Min= 1 :- Edge(x, y); D(x, z) Min= D(x, y) + 1 :- Edge(y, z); Q(x:, y:, d:) :- D(x, y) == d;",
    f"WITH RECURSIVE {_EDGES_SQL}, c(x, y, d) AS (SELECT x, y, 1::BIGINT FROM edge UNION SELECT c.x, e.y, c.d + 1 FROM c JOIN edge e ON c.y = e.x) SELECT x, y, min(d) AS d FROM c GROUP BY ALL",
)
#: The recursion over the whole edge table, cycles included: orders to their customers' numbers, no filter.
#: Recursive SQL is too slow for these; they are tested against brute force.
_ALL_EDGES = "Edge(x, y) distinct :- orders(o_orderkey: x, o_custkey: y);"
WHOLE: dict[str, str] = {
    "closure_all_orders": _ALL_EDGES + "@Recursive(C, -1); C(x, y) distinct :- Edge(x, y); C(x, z) distinct :- C(x, y), Edge(y, z); Q(x:, y:) :- C(x, y);",
    "distance_all_orders": _ALL_EDGES + "@Recursive(D, -1); D(x, y) Min= 1 :- Edge(x, y); D(x, z) Min= D(x, y) + 1 :- Edge(y, z); Q(x:, y:, d:) :- D(x, y) == d;",
}

query(
    "same_generation",
    "Parent(x, y) distinct :- supplier(s_suppkey: s), x == ToInt64(s), x > 0, y == ToInt64(Floor((x - 1) / 3)); @Recursive(S, -1); S(x, y) distinct :- Parent(x, p), Parent(y, p); S(x, y) distinct :- Parent(x, a), S(a, b), Parent(y, b); Q(x:, y:) :- S(x, y);",
    "WITH RECURSIVE parent AS (SELECT DISTINCT s_suppkey::BIGINT AS x, ((s_suppkey - 1) // 3)::BIGINT AS y FROM supplier WHERE s_suppkey > 0), s(x, y) AS (SELECT a.x, b.x FROM parent a JOIN parent b ON a.y = b.y UNION SELECT a.x, b.x FROM parent a JOIN s ON a.y = s.x JOIN parent b ON b.y = s.y) SELECT x, y FROM s",
)
query(
    "subtraction_game",
    "Position(x) distinct :- nation(n_nationkey: n), x == ToInt64(n); Move(x, y) distinct :- Position(x), y in [x - 1, x - 2, x - 3, x - 4, x - 5, x - 6, x - 7, x - 8], y >= 0;"
    '@Recursive(Win, -1); Win(x) distinct :- Move(x, y), ~Win(y); Q(x:, state: "win") :- Win(x); Q(x:, state: "loss") :- Position(x), ~Win(x);',
    # who may take 1 to 8 and loses when nothing is left, loses from multiples of 9
    "SELECT n_nationkey::BIGINT AS x, CASE WHEN n_nationkey % 9 = 0 THEN 'loss' ELSE 'win' END AS state FROM nation",
)
_TREE = "Child(p, c) distinct :- supplier(s_suppkey: s), c == ToInt64(s), c > 1, p == ToInt64(Floor((c + 1) / 3));"
_TREE_SQL = "WITH RECURSIVE r(x, d) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT s_suppkey::BIGINT, d + 1 FROM r JOIN supplier ON (s_suppkey + 1) // 3 = x AND s_suppkey > 1)"
query(
    "layers_until_a_third",
    _TREE + "@Recursive(Reach, -1, stop: Enough); Reach(x) distinct :- x in [1]; Reach(c) distinct :- Reach(p), Child(p, c); Enough() :- n += (1 :- Reach(x)), m += (1 :- supplier(s_suppkey: s)), 3 * n > m; Q(x:) :- Reach(x);",
    _TREE_SQL + ", layers AS (SELECT d, sum(count(*)) OVER (ORDER BY d) AS upto FROM r GROUP BY d) SELECT x FROM r WHERE d <= (SELECT min(d) FROM layers WHERE 3 * upto > (SELECT count(*) FROM supplier))",
)
query(
    "even_and_odd_layers",
    _TREE + '@Recursive(Even, -1); Even(x) distinct :- x in [1]; Odd(c) distinct :- Even(p), Child(p, c); Even(c) distinct :- Odd(p), Child(p, c); Q(x:, layer: "even") :- Even(x); Q(x:, layer: "odd") :- Odd(x);',
    _TREE_SQL + " SELECT x, CASE WHEN d % 2 = 0 THEN 'even' ELSE 'odd' END AS layer FROM r",
)
query("customer_distribution", "N(c, n) :- customer(c_custkey: c), n Count= (o :- orders(o_custkey: c, o_orderkey: o)); Q(orders: n, customers? += 1) distinct :- N(c, n);", "SELECT n AS orders, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY ALL")
query("hash_fns", "Q(n:, m: ToHex(Md5(name)), s: ToHex(Sha256(name)), b: ToBase64(Md5(name))) :- nation(n_nationkey: n, n_name: name);", "SELECT n_nationkey AS n, md5(n_name) AS m, sha256(n_name) AS s, base64(unhex(md5(n_name))) AS b FROM nation")
query("array_agg_concat", "Q(r:, x: Sort(x)) :- region(r_regionkey: r), x ++= ([k, k] :- nation(n_regionkey: r, n_nationkey: k));", "SELECT n_regionkey AS r, list_sort(flatten(list([n_nationkey, n_nationkey]))) AS x FROM nation GROUP BY ALL")
query("some_value", "Q(r:, name? SomeValue= n) distinct :- region(r_regionkey: r, r_name: n), nation(n_regionkey: r);", "SELECT r_regionkey AS r, r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
query("approx_functions", "Q(n? ApproxCountDistinct= k) distinct :- nation(n_regionkey: k);", "SELECT count(DISTINCT n_regionkey) AS n FROM nation")
query(
    "date_boundaries",
    'Q(id:, days: DatetimeDiff(b, a, "DAY"), weeks: DateDiff(ToDate(b), ToDate(a), "WEEK"), iso_weeks: DateDiff(ToDate(b), ToDate(a), "ISOWEEK"), quarters: DateDiff(ToDate(b), ToDate(a), "QUARTER"), hours: DatetimeDiff(b, a, "HOUR"),'
    ' week: ToString(DateTrunc(ToDate(a), "WEEK")), iso: ToString(DateTrunc(ToDate(a), "ISOWEEK")), tuesday: ToString(DateTrunc(ToDate(a), "WEEK(TUESDAY)")), first: DateDiff("DAY", ToDate(a), ToDate(b)), text: FormatDate("%d/%m/%Y", ToDate(a)))'
    " :- orders(o_orderkey: id, o_orderdate: a), lineitem(l_orderkey: id, l_shipdate: b);",
    "SELECT o_orderkey AS id, date_diff('day', a, b) AS days, (date_trunc('week', b::DATE + 1)::DATE - date_trunc('week', a::DATE + 1)::DATE) // 7 AS weeks, (date_trunc('week', b)::DATE - date_trunc('week', a)::DATE) // 7 AS iso_weeks, date_diff('quarter', a, b) AS quarters, date_diff('hour', a, b) AS hours,"
    " (date_trunc('week', a::DATE + 1)::DATE - 1)::VARCHAR AS week, date_trunc('week', a)::DATE::VARCHAR AS iso, (date_trunc('week', a::DATE - 1)::DATE + 1)::VARCHAR AS tuesday, date_diff('day', a, b) AS first, strftime(a, '%d/%m/%Y') AS text"
    " FROM (SELECT o_orderkey, o_orderdate AS a, l_shipdate AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)",
)
query(
    "integers_and_ranges",
    "Q(p:, whole: Div(9007199254740993 + p, s), back: Div(-p, 7), down: GenerateArray(n, 1, -2), up: GenerateArray(1, n), none: GenerateArray(n, 0, 3), left: Mod(p, 7)) :- part(p_partkey: k, p_size: z), p == ToInt64(k), s == ToInt64(z), n == p % 9 + 1;",
    "SELECT p, (9007199254740993 + p) // s AS whole, -(p // 7) AS back, range(n, 0, -2) AS down, range(1, n + 1) AS up, []::BIGINT[] AS none, p % 7 AS left"
    " FROM (SELECT p_partkey::BIGINT AS p, p_size::BIGINT AS s, p_partkey::BIGINT % 9 + 1 AS n FROM part)",
)
query(
    "bytes_and_encodings",
    'Q(p:, hex: ToHex(Sha1(n)), back: FromHex(ToHex(Md5(n))) == Md5(n), b64: ToBase64(Sha256(n)), size: ByteLength(n), rev: Reverse(n), rep: Repeat(b, 2), trim: Trim(Rpad(b, 14, " ")), cut: Ltrim(Lpad(b, 14, "x"), "x"), starts: StartsWith(n, "a"), ends: EndsWith(n, "e"), low: Lower(b), title: Initcap(b)) :- part(p_partkey: p, p_name: n, p_brand: b);',
    "SELECT p_partkey AS p, sha1(p_name) AS hex, true AS back, base64(unhex(sha256(p_name))) AS b64, strlen(p_name)::INTEGER AS size, reverse(p_name) AS rev, repeat(p_brand, 2) AS rep, p_brand AS trim, p_brand AS cut, starts_with(p_name, 'a') AS starts, ends_with(p_name, 'e') AS ends, lower(p_brand) AS low,"
    " list_aggregate(list_transform(string_split(p_brand, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM part",
)
query(
    "numeric_functions",
    "Q(s:, a: Round(Sin(b), 9), c: Round(Cos(b), 9), t: Round(Atan2(b, 2.0), 9), e: Round(Exp(b / 10000.0), 9), l2: Round(Log10(Abs(b) + 1.0), 9), cut: Trunc(b), gap: Greatest(b, 0.0), same: Ifnull(Nullif(b, b), 1.5), most: Coalesce(Nullif(k, k), k), r: Round(b, 1)) :- supplier(s_suppkey: s, s_acctbal: b, s_nationkey: k);",
    "SELECT s_suppkey AS s, round(sin(s_acctbal), 9) AS a, round(cos(s_acctbal), 9) AS c, round(atan2(s_acctbal, 2.0), 9) AS t, round(exp(s_acctbal / 10000.0), 9) AS e, round(log10(abs(s_acctbal) + 1.0), 9) AS l2, trunc(s_acctbal)::BIGINT AS cut,"
    " greatest(s_acctbal, 0.0) AS gap, 1.5::DOUBLE AS same, s_nationkey AS most, round(s_acctbal, 1) AS r FROM supplier",
)
query(
    "date_parts",
    'Q(k:, y: Year(d), m: Month(d), day: Day(d), q: Quarter(d), doy: Dayofyear(d), last: ToString(LastDay(d)), plus: ToString(DateAdd(d, 45)), minus: ToString(DateSub(d, 45)), unix: UnixDate(d), month: ToString(DateTrunc(d, "MONTH"))) :- orders(o_orderkey: k, o_orderdate: t), d == ToDate(t);',
    "SELECT o_orderkey AS k, year(d)::INTEGER AS y, month(d)::INTEGER AS m, day(d)::INTEGER AS day, quarter(d)::INTEGER AS q, dayofyear(d)::INTEGER AS doy, last_day(d)::VARCHAR AS last, (d + 45)::VARCHAR AS plus, (d - 45)::VARCHAR AS minus, (d - DATE '1970-01-01')::INTEGER AS unix, date_trunc('month', d)::DATE::VARCHAR AS month FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
)


def _tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{t}(" in text}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = WHOLE[name] if name in WHOLE else QUERIES[name][0]
    return Program(text, spark, tables=_tables(spark, sf_dir, text)).df("Q")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, n=n: run(spark, sf_dir, n)) for n in (*QUERIES, *WHOLE)}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
