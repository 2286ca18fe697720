"""SQL fragments shared by the queries' SQL."""

from __future__ import annotations

from ..functions.normalise import STAND_INS

STAND = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\x{{00A0}}\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))"


def usable(c: str) -> str:
    return f"coalesce(lower({squeeze(c)}) not in ({STAND}), false)"


def base(c: str) -> str:
    s = f"regexp_replace(regexp_replace(upper({c}), '[^\\p{{L}}\\p{{Nd}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"nullif(regexp_replace(regexp_extract({s}, '^(CVE_?\\d{{4}}_\\d+)(?:_AUGU?MENTED_?\\d*)?$', 1), '^CVE_?', 'CVE_'), 'CVE_')"
