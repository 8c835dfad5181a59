"""Portable integer hash: the same numbers in Spark and in any 64-bit SQL engine.

Resampling, sign flips and shuffles draw from it, so results do not depend on
partitioning, retries or cluster size. x -> x^5 is a permutation modulo P.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
_ID, _REP, _REP_MOD = 48271, 69621, 1000003


def portable_hash(item: Column, rep: Column, salt: int) -> Column:
    x = (item.cast("long") % P * _ID + rep.cast("long") % _REP_MOD * _REP + F.lit(salt)) % P
    x2 = x * x % P
    x4 = x2 * x2 % P
    return x4 * x % P


def hash_array(item: np.ndarray, rep: np.ndarray, salt: int) -> np.ndarray:
    """portable_hash of whole arrays of non-negative numbers, inside a task."""
    x = (item.astype(np.int64) % P * _ID + rep.astype(np.int64) % _REP_MOD * _REP + salt) % P
    x2 = x * x % P
    return x2 * x2 % P * x % P


def hash_sign(item: Column, rep: Column, salt: int) -> Column:
    """-1 or +1."""
    bit = F.shiftright(portable_hash(item, rep, salt), 16).bitwiseAND(F.lit(1))
    return bit * 2 - 1


def portable_hash_sql(item: str, rep: str, salt: int) -> str:
    x = f"((({item})::BIGINT % {P} * {_ID} + ({rep})::BIGINT % {_REP_MOD} * {_REP} + {salt}) % {P})"
    x2 = f"({x} * {x} % {P})"
    x4 = f"({x2} * {x2} % {P})"
    return f"({x4} * {x} % {P})"


def hash_sign_sql(item: str, rep: str, salt: int) -> str:
    return f"((({portable_hash_sql(item, rep, salt)} // 65536) & 1) * 2 - 1)"
