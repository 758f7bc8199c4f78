"""DuckDB SQL for what Spark expressions compute, used to check results."""

from __future__ import annotations

from keyspan.plans.catalog import ShardCatalog

# Fixed values of the xxHash64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SPACE = "18446744073709551616::UHUGEINT"


def _times(x: str, y: int) -> str:
    return f"((({x})::UHUGEINT * {y}::UHUGEINT) % {_SPACE})::UBIGINT"


def _rotate(x: str, by: int) -> str:
    return f"(((({x})::UHUGEINT * {1 << by}::UHUGEINT) % {_SPACE}) + ({x})::UHUGEINT // {1 << (64 - by)}::UHUGEINT)::UBIGINT"


def positions(keys: str, name: str = "placed") -> str:
    """CTEs ending in `name` (k, id UBIGINT): positions of the integers k that the query `keys` gives.

    Stages are materialised over distinct keys: as nested expressions each would be worked out many times.
    """
    swapped = " + ".join(f"((u // {1 << (8 * i)}::UHUGEINT) % 256::UHUGEINT) * {1 << (8 * (7 - i))}::UHUGEINT" for i in range(8))
    stages = [
        ("keys", f"SELECT DISTINCT k::BIGINT AS k FROM ({keys})"),
        ("wide", f"SELECT k, CASE WHEN k < 0 THEN {_SPACE} - (-k::HUGEINT)::UHUGEINT ELSE k::UHUGEINT END AS u FROM keys"),
        ("lane", f"SELECT k, ({swapped})::UBIGINT AS h FROM wide"),
        ("s1", f"SELECT k, {_times('h', _P2)} AS h FROM lane"),
        ("s2", f"SELECT k, {_rotate('h', 31)} AS h FROM s1"),
        ("s3", f"SELECT k, xor({(_P5 + 8)}::UBIGINT, {_times('h', _P1)}) AS h FROM s2"),
        ("s4", f"SELECT k, {_rotate('h', 27)} AS h FROM s3"),
        ("s5", f"SELECT k, (({_times('h', _P1)}::UHUGEINT + {_P4}::UHUGEINT) % {_SPACE})::UBIGINT AS h FROM s4"),
        ("s6", f"SELECT k, {_times(f'xor(h, h // {1 << 33}::UBIGINT)', _P2)} AS h FROM s5"),
        ("s7", f"SELECT k, {_times(f'xor(h, h // {1 << 29}::UBIGINT)', _P3)} AS h FROM s6"),
        (name, f"SELECT k, xor(h, h // {1 << 32}::UBIGINT) AS id FROM s7"),
    ]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in stages)


def positions_of_hex(keys: str, name: str = "placed") -> str:
    """CTEs ending in `name` (k, id UBIGINT): positions of keys of 16 bytes, which the query `keys` gives as (k, h) in hex."""
    lane = lambda at: " + ".join(f"('0x' || substr(h, {2 * i + 1 + at}, 2))::UHUGEINT * {1 << (8 * i)}::UHUGEINT" for i in range(8))
    stages = [
        ("keys", keys),
        ("lanes", f"SELECT k, ({lane(0)})::UBIGINT AS a, ({lane(16)})::UBIGINT AS b FROM keys"),
        ("a1", f"SELECT k, b, {_times('a', _P2)} AS a FROM lanes"),
        ("a2", f"SELECT k, b, {_rotate('a', 31)} AS a FROM a1"),
        ("a3", f"SELECT k, b, xor({(_P5 + 16)}::UBIGINT, {_times('a', _P1)}) AS h FROM a2"),
        ("a4", f"SELECT k, b, {_rotate('h', 27)} AS h FROM a3"),
        ("a5", f"SELECT k, (({_times('h', _P1)}::UHUGEINT + {_P4}::UHUGEINT) % {_SPACE})::UBIGINT AS h, {_times('b', _P2)} AS b FROM a4"),
        ("b2", f"SELECT k, h, {_rotate('b', 31)} AS b FROM a5"),
        ("b3", f"SELECT k, xor(h, {_times('b', _P1)}) AS h FROM b2"),
        ("b4", f"SELECT k, {_rotate('h', 27)} AS h FROM b3"),
        ("b5", f"SELECT k, (({_times('h', _P1)}::UHUGEINT + {_P4}::UHUGEINT) % {_SPACE})::UBIGINT AS h FROM b4"),
        ("s6", f"SELECT k, {_times(f'xor(h, h // {1 << 33}::UBIGINT)', _P2)} AS h FROM b5"),
        ("s7", f"SELECT k, {_times(f'xor(h, h // {1 << 29}::UBIGINT)', _P3)} AS h FROM s6"),
        (name, f"SELECT k, xor(h, h // {1 << 32}::UBIGINT) AS id FROM s7"),
    ]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in stages)


def shard_case(shards: ShardCatalog, position: str = "id") -> str:
    arms = [f"WHEN {position} < {r.end}::UBIGINT THEN '{n}'" for n, r in shards.shards[:-1]]
    return f"CASE {' '.join(arms)} ELSE '{shards.shards[-1][0]}' END"


def bound_text(column: str) -> str:
    """A UBIGINT as a bound is spelled."""
    return f"regexp_replace(lpad(lower(to_hex({column})), 16, '0'), '(00)+$', '')"


