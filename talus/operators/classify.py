"""Report classifiers by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V


#: \b of ASCII words in lookarounds: Java's own goes by other letters than the patterns mean.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _patterns(plain: dict[str, str], oracle: bool) -> dict[str, str]:
    return plain if oracle else {k: p.replace(r"\b", _EDGE) for k, p in plain.items()}


def ops_patterns(oracle: bool = False) -> dict[str, str]:
    return _patterns({"force": V.OPS_FORCE, "verb": V.OPS_VERB, "title": V.OPS_ATTACK_TITLE, "victim": V.OPS_VICTIM, "harm": V.OPS_HARM}, oracle)


def attacker_patterns(oracle: bool = False) -> dict[str, str]:
    deaths = f"{V.CLEAN_DEATHS}.*{V.CLEAN_ATTACKERS}|{V.CLEAN_ATTACKERS}.*{V.CLEAN_DEATHS}"
    near = f"{V.CLEAN_CIVILIAN_HARM}|{V.CLEAN_ROLE_HARM}|{V.CLEAN_HARM_ROLE}"
    plain = {"force": V.CLEAN_FORCE, "deaths": deaths, "near": near, "role": V.CLEAN_VICTIM, "harm": V.CLEAN_HARM, "active": V.CLEAN_ACTIVE_TITLE, "rescue": V.CLEAN_RESCUE, "count": V.CLEAN_COUNT}
    return _patterns(plain, oracle)


def _combined() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))


def is_operational_update(title: str = "title") -> Column:
    """A security operation with an operational verb, no harm to victims, and no attack in the title."""
    p, c = ops_patterns(), _combined()
    return c.rlike(p["force"]) & c.rlike(p["verb"]) & ~(c.rlike(p["victim"]) & c.rlike(p["harm"])) & ~F.lower(F.coalesce(title, F.lit(""))).rlike(p["title"])


def attacker_only_reason() -> Column:
    """Why a report counts only the deaths of attackers (operation, rescue, count), or null: it stays."""
    p, c = attacker_patterns(), _combined()
    keep = c.rlike(p["near"]) | (c.rlike(p["role"]) & c.rlike(p["harm"])) | F.lower(F.coalesce("title", F.lit(""))).rlike(p["active"])
    force, deaths = c.rlike(p["force"]), c.rlike(p["deaths"])
    killed, injured, kidnapped, displaced = (F.coalesce(F.col(x), F.lit(0)) for x in ("killed", "injured", "kidnapped", "displaced"))
    n = F.regexp_extract(c, p["count"], 2).try_cast("int")
    return (
        F.when(keep, None)
        .when(force & deaths, "operation")
        .when(force & c.rlike(p["rescue"]) & ((killed > 0) | (injured > 0)) & (kidnapped == 0) & (displaced == 0), "rescue")
        .when(deaths & n.isNotNull() & (killed > 0) & (killed <= n + 5), "count")
    )
