"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from skyvane.sources.observations import BURSTS_SQL, EPISODES_SQL, TRACK_SQL

B, T, E = BURSTS_SQL, TRACK_SQL, EPISODES_SQL


def shown(x: str, digits: int = 4) -> str:
    return f"round(({x}) + 3.3e-{digits + 2}, {digits})"


def mod360(x: str) -> str:
    return f"((({x}) % 360) + 360) % 360"


def dist(a: str, b: str) -> str:
    return f"abs({mod360(f'({a}) - ({b}) + 180')} - 180)"


def cmean(b: str = "bearing") -> str:
    return mod360(f"degrees(atan2(avg(sin(radians({b}))), avg(cos(radians({b})))))")


def smean(b: str = "bearing") -> str:
    return mod360(f"degrees(atan2(sum(sin(radians({b}))), sum(cos(radians({b})))))")


def res(b: str = "bearing") -> str:
    return f"sqrt(pow(avg(cos(radians({b}))), 2) + pow(avg(sin(radians({b}))), 2))"


def us(t: str) -> str:
    return f"epoch_us({t})"
