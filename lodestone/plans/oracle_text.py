"""The text scalars as DuckDB SQL, for the oracle only."""

from __future__ import annotations

from lodestone.functions import text as T


def fold(x: str) -> str:
    marked, plain = T.accent_map()
    return f"regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), '{marked}', '{plain}'), '[̀-ͯ]', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(regexp_replace({fold(x)}, '{T.HYPHENS}', ' ', 'g'), '{T.TOKEN}')"


def canonical(t: str) -> str:
    t = f"trim({t}, '.-')"
    adverbs = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in T.PROFICIENCY_ADVERBS.items())
    manage = ", ".join(f"'{m}'" for m in T.MANAGEMENT)
    return (
        f"CASE WHEN {t} IN ('accessible', 'accessibility') THEN 'accessibility' {adverbs} WHEN {t} IN ({manage}) THEN 'manage' "
        f"WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN substr({t}, 1, length({t}) - 3) || 'y' "
        f"WHEN {t} LIKE '%s' AND length({t}) > 4 AND {t} NOT LIKE '%ss' THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"
    )


def canonical_terms(x: str) -> str:
    return f"list_filter([{canonical('t')} FOR t IN {tokens(x)}], lambda t: t <> '')"
