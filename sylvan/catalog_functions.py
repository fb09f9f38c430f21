"""Registered queries of the function library: each column is an expression and the SQL that gives the same values.

name, table, key column, then (expression, type to cast to or None, SQL) for each column.
"""

FUNCTIONS: dict[str, tuple[str, str, list[tuple[str, str | None, str]]]] = {
    "cardinality": ("part", "p_partkey", [
        ("empty(tokenize(p_type)[. = 'STEEL'])", None, "NOT list_contains(string_split(p_type, ' '), 'STEEL')"),
        ("count(data((p_size, 7)))", "long", "2"),
        ("exactly-one(p_size)", "long", "p_size"),
        ("count(one-or-more(tokenize(p_type)))", "long", "len(string_split(p_type, ' '))"),
        ("count(zero-or-one(tokenize(p_type)[. = 'STEEL']))", "long", "len(list_filter(string_split(p_type, ' '), lambda x: x = 'STEEL'))"),
        ("string-join(unordered(tokenize(p_type)), '-')", None, "replace(p_type, ' ', '-')"),
        ("trace(p_size, 'size')", "long", "p_size"),
        ("true() and not(false())", None, "true"),
        ("deep-equal((p_size, 1), (p_size, 1))", None, "true"),
        ("deep-equal(tokenize(p_type), ('a', 'b'))", None, "false"),
        ("string(p_size)", None, "CAST(p_size AS VARCHAR)"),
        ("string-join(tokenize(p_type) ! upper-case(.), '+')", None, "upper(replace(p_type, ' ', '+'))"),
    ]),
    "positions_in_sequences": ("part", "p_partkey", [
        ("string-join(tail(tokenize(p_type)), ' ')", None, "array_to_string(string_split(p_type, ' ')[2:], ' ')"),
        ("string-join(subsequence(tokenize(p_type), 2, 1), ' ')", None, "array_to_string(string_split(p_type, ' ')[2:2], ' ')"),
        ("string-join(remove(tokenize(p_type), 1), ' ')", None, "array_to_string(string_split(p_type, ' ')[2:], ' ')"),
        ("string-join(insert-before(tokenize(p_type), 2, 'x'), ' ')", None, "array_to_string(list_concat(list_concat(string_split(p_type, ' ')[1:1], ['x']), string_split(p_type, ' ')[2:]), ' ')"),
        ("count(index-of((p_size, 1, p_size), p_size))", "long", "CASE WHEN p_size = 1 THEN 3 ELSE 2 END"),
        ("min((p_size, 10))", "long", "least(p_size, 10)"),
        ("min((p_retailprice, 1000e0))", None, "least(p_retailprice, 1000)"),
        ("avg((p_size, p_size + 2))", "double", "CAST(p_size + 1 AS DOUBLE)"),
        ("string-join(distinct-values((p_brand, p_brand, 'b')), ',')", None, "p_brand || ',b'"),
    ]),
    "functions_as_values": ("part", "p_partkey", [
        ("fold-right((1, 2, 3), p_size, function($x, $s) { $s * 2 + $x })", "long", "8 * p_size + 1 + 2 * (2 + 2 * 3)"),
        ("function-arity(upper-case#1)", "long", "1"),
        ("contains(string(function-name(upper-case#1)), 'upper-case')", None, "true"),
        ("default-language()", None, "'en'"),
        ("contains(default-collation(), 'codepoint')", None, "true"),
        ("let $f := function($a, $b) { $a * 10 + $b } return $f(p_size, 3)", "long", "p_size * 10 + 3"),
        ("empty(environment-variable('no such variable of ours'))", None, "true"),
        ("apply(function($a, $b) { $a + $b }, [p_size, 4])", "long", "p_size + 4"),
    ]),
    "string_tests": ("customer", "c_custkey", [
        ("codepoint-equal(c_mktsegment, 'BUILDING')", None, "c_mktsegment = 'BUILDING'"),
        ("contains-token(concat(c_mktsegment, ' x'), 'BUILDING')", None, "c_mktsegment = 'BUILDING'"),
        ("ends-with(c_mktsegment, 'ING')", None, "suffix(c_mktsegment, 'ING')"),
        ("substring-before(c_name, '#')", None, "split_part(c_name, '#', 1)"),
        ("escape-html-uri(concat(c_name, ' é'))", None, "c_name || ' %C3%A9'"),
        ("collation-key(c_mktsegment) = collation-key('BUILDING')", None, "c_mktsegment = 'BUILDING'"),
        ("string-join(('a', c_mktsegment), '/')", None, "'a/' || c_mktsegment"),
        ("c_mktsegment || c_nationkey", None, "c_mktsegment || c_nationkey"),
    ]),
    "numbers_in_pictures": ("orders", "o_orderkey", [
        ("format-integer(o_orderkey, '#,##0')", None, "format('{:,}', o_orderkey)"),
        ("format-number(o_totalprice, '#,##0.00')", None, "format('{:,.2f}', o_totalprice)"),
        ("format-integer(o_custkey mod 30 + 1, '000')", None, "lpad(CAST(o_custkey % 30 + 1 AS VARCHAR), 3, '0')"),
        ("format-integer(o_custkey mod 26 + 1, 'a')", None, "chr(CAST(97 + o_custkey % 26 AS INTEGER))"),
        ("format-integer(o_custkey mod 4 + 1, 'I')", None, "['I', 'II', 'III', 'IV'][o_custkey % 4 + 1]"),
        ("round-half-to-even(o_custkey div 2)", "long", "CAST(round_even(o_custkey / 2.0, 0) AS BIGINT)"),
        ("format-number(o_custkey, '0')", None, "CAST(o_custkey AS VARCHAR)"),
    ]),
    "trigonometry": ("part", "p_partkey", [
        ("round(math:acos(p_size div 100e0), 9)", None, "floor(acos(p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:asin(p_size div 100e0), 9)", None, "floor(asin(p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:atan(p_size div 100e0), 9)", None, "floor(atan(p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:cos(p_size div 100e0), 9)", None, "floor(cos(p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:tan(p_size div 100e0), 9)", None, "floor(tan(p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:exp(p_size div 100e0), 9)", None, "floor(exp(p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:exp10(p_size div 100e0), 9)", None, "floor(pow(10, p_size / 100.0::DOUBLE) * 1e9 + 0.5) / 1e9"),
        ("round(math:log10(p_retailprice), 9)", None, "floor(log10(p_retailprice) * 1e9 + 0.5) / 1e9"),
        ("round(math:pi(), 9)", None, "floor(pi() * 1e9 + 0.5) / 1e9"),
    ]),
    "dates_and_times": ("orders", "o_orderkey", [
        ("year-from-date(xs:date(o_orderdate))", "long", "year(o_orderdate)"),
        ("month-from-date(xs:date(o_orderdate))", "long", "month(o_orderdate)"),
        ("day-from-date(xs:date(o_orderdate))", "long", "day(o_orderdate)"),
        ("minutes-from-dateTime(o_orderdate)", "long", "minute(o_orderdate)"),
        ("seconds-from-dateTime(o_orderdate)", "double", "CAST(second(o_orderdate) AS DOUBLE)"),
        ("format-date(xs:date(o_orderdate), '[Y0001]-[M01]-[D01]')", None, "strftime(o_orderdate, '%Y-%m-%d')"),
        ("current-date() = current-date()", None, "true"),
        ("current-dateTime() = current-dateTime()", None, "true"),
        ("year-from-date(current-date()) >= 2024", None, "true"),
        ("string(parse-ietf-date('Wed, 06 Jun 1994 07:29:35')) = string(xs:dateTime('1994-06-06T07:29:35'))", None, "true"),
        ("o_orderdate - xs:dateTime('1992-01-01T00:00:00') > xs:dayTimeDuration('P30D')", None, "o_orderdate - TIMESTAMP '1992-01-01' > INTERVAL 30 DAY"),
    ]),
    "durations": ("nation", "n_nationkey", [
        ("years-from-duration(xs:yearMonthDuration('P3Y5M'))", "long", "3"),
        ("months-from-duration(xs:yearMonthDuration('P3Y5M'))", "long", "5"),
        ("days-from-duration(xs:dayTimeDuration('P2DT3H4M5.5S'))", "long", "2"),
        ("hours-from-duration(xs:dayTimeDuration('P2DT3H4M5.5S'))", "long", "3"),
        ("minutes-from-duration(xs:dayTimeDuration('P2DT3H4M5.5S'))", "long", "4"),
        ("seconds-from-duration(xs:dayTimeDuration('P2DT3H4M5.5S'))", "double", "5.5::DOUBLE"),
        ("hours-from-duration(xs:dayTimeDuration('PT1H') * n_nationkey)", "long", "n_nationkey % 24"),
        ("hours-from-duration(implicit-timezone())", "long", "0"),
    ]),
    "names": ("nation", "n_nationkey", [
        ("local-name-from-QName(QName('http://x.example/', concat('p:', n_name)))", None, "n_name"),
        ("prefix-from-QName(QName('http://x.example/', concat('p:', n_name)))", None, "'p'"),
        ("namespace-uri-from-QName(QName('http://x.example/', n_name))", None, "'http://x.example/'"),
        ("static-base-uri()", None, "''"),
    ]),
    "maps": ("part", "p_partkey", [
        ("map:contains(map{'a': 1}, p_brand)", None, "false"),
        ("map:get(map{'a': p_size}, 'a')", "long", "p_size"),
        ("map:size(map:entry(p_brand, p_size))", "long", "1"),
        ("string-join(sort(map:keys(map{'b': 1, 'a': 2})), ',')", None, "'a,b'"),
        ("map:size(map:remove(map{'a': 1, 'b': 2}, 'a'))", "long", "1"),
        ("sum(map:for-each(map{'a': p_size, 'b': 2}, function($k, $v) { $v * 2 }))", "long", "2 * p_size + 4"),
        ("map:merge((map{'a': 1}, map{'a': p_size}), map{'duplicates': 'use-last'})?a", "long", "p_size"),
        ("map:merge((map{'a': 1}, map{'a': p_size}), map{'duplicates': 'use-first'})?a", "long", "1"),
        ("map:size(map:merge((map{'a': 1}, map{'b': p_size}), map{'duplicates': 'reject'}))", "long", "2"),
        ("serialize(map{'a': p_size}, map{'method': 'json'})", None, "'{\"a\":' || p_size || '}'"),
        ("string-join(map:find(map{'a': p_brand}, 'a'), ',')", None, "p_brand"),
    ]),
    "arrays": ("part", "p_partkey", [
        ("sum(array:flatten(array:filter([1, p_size, 60], function($x) { $x > 50 })))", "long", "60 + CASE WHEN p_size > 50 THEN p_size ELSE 0 END"),
        ("array:fold-left([1, 2, p_size], 0, function($s, $x) { $s * 2 + $x })", "long", "8 + p_size"),
        ("array:fold-right([1, 2, p_size], 0, function($x, $s) { $s * 2 + $x })", "long", "4 * p_size + 5"),
        ("sum(array:flatten(array:for-each([1, p_size], function($x) { $x * 3 })))", "long", "3 + 3 * p_size"),
        ("sum(array:flatten(array:for-each-pair([1, p_size], [2, 3], function($a, $b) { $a * $b })))", "long", "2 + 3 * p_size"),
        ("array:head([p_size, 2])", "long", "p_size"),
        ("array:get(array:insert-before([1, 2], 2, p_size), 2)", "long", "p_size"),
        ("array:size(array:join(([1], [2, p_size])))", "long", "3"),
        ("array:get(array:put([1, 2], 2, p_size), 2)", "long", "p_size"),
        ("array:size(array:remove([1, 2, p_size], 2))", "long", "2"),
        ("array:get(array:reverse([1, 2, p_size]), 1)", "long", "p_size"),
        ("array:get(array:sort([100, p_size]), 1)", "long", "p_size"),
        ("array:size(array:tail([1, 2, p_size]))", "long", "2"),
    ]),
}
