"""Pieces of DuckDB SQL that several oracles share."""

ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def words(c: str) -> str:
    """Runs of letters and digits, lower-cased, without accents."""
    return rf"regexp_extract_all(translate(lower(coalesce({c}, '')), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\p{{L}}\p{{N}}]+')"


def windows(c: str) -> str:
    """The whole text, its parts and windows of 4 characters, distinct."""
    whole = rf"lower(trim(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')))"
    parts = rf"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '[\s,，、；;。.]+'), lambda p: lower(trim(p))), lambda p: length(p) >= 2)"
    grams = f"flatten(list_transform({parts}, lambda p: list_transform(range(1, length(p)), lambda i: substr(p, i, 4))))"
    return f"CASE WHEN {whole} = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_concat(list_concat([{whole}], list_filter({parts}, lambda p: length(p) <= 30)), {grams})) END"


def session_terms(c: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '[,，；;\s/]+'), lambda t: lower(trim(t))), lambda t: length(t) >= 2)"


def keyword(text: str, word: str) -> str:
    """The keyword rule for one word."""
    if word.isascii() and len(word) <= 4:
        return rf"regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{Nd}}]){word}([^\p{{L}}\p{{Nd}}]|$)')"
    return f"contains(lower({text}), '{word.lower()}')"
