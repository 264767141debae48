"""Column expressions on text, all inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that begin a question, and tails that end one.
LEADS = (
    "ayúdame a encontrar", "podrías ayudarme a encontrar", "busca", "encuentra", "dime sobre", "háblame de", "tienes algo sobre", "algún artículo sobre", "alguna nota sobre",
    "is it true that", "can you help me find", "tell me about", "do you have anything on", "search for", "find", "look for", "i read that", "i heard that", "i was told that",
    "can you confirm that", "is it correct that", "did you know that",
)
TAILS = (r"right\?", r"correct\?", "is that right", "is that true", "can you confirm")
LEAD_PATTERN = rf"^(?:{'|'.join(LEADS)})\s+"
TAIL_PATTERN = rf"\s*(?:{'|'.join(TAILS)})\s*$"
#: Punctuation that becomes a blank in queries.
QUERY_PUNCTUATION = r"[.,/#!$%^&*;:{}=\-_`~()]"

# Words that carry no search meaning, accents off.
STOP_WORDS = [
    "ayudame", "encontrar", "podrias", "busca", "encuentra", "dime", "sobre", "hablame", "tienes", "algo", "articulo", "nota", "notas", "vault", "boveda", "mi", "mis",
    "the", "and", "for", "with", "from", "that", "this", "these", "those", "about", "find", "help", "note", "search", "does", "what", "where", "when", "how", "why",
    "who", "which", "un", "una", "unos", "unas", "el", "la", "los", "las", "en", "con", "por", "para", "que", "del", "al", "was", "were", "been", "have", "has", "had",
    "pais", "paises", "estilos", "generos", "periodos", "estructuras",
]


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters below U+2000 and from U+1E00 whose decomposition is one base letter and marks U+0300-036F, with their bases."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if not 0x300 <= ord(c) <= 0x36F]
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    source, target = _accents()
    return F.regexp_replace(F.translate(F.lower(c), source, target), "[̀-ͯ]", "")


def tag_key(c: Column) -> Column:
    """Comparison key of a tag: blanks and underscores are one underscore, case and accents don't count."""
    return fold(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", "_"), "_+", "_"))


def refine_query(c: Column) -> Column:
    lead = F.regexp_replace(F.lower(c), LEAD_PATTERN, "")
    return F.trim(F.regexp_replace(F.regexp_replace(lead, r"\?+$", ""), f"(?i){TAIL_PATTERN}", ""))


def quoted_terms(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit('"([^"]+)"'), F.lit(1))


def search_terms(c: Column) -> Column:
    clean = F.regexp_replace(fold(refine_query(c)), QUERY_PUNCTUATION, " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > 2)


def distilled_query(c: Column) -> Column:
    return F.array_join(F.filter(search_terms(c), lambda t: F.length(t) > 3), " ")


def model_prefix(model: Column, side: str) -> Column:
    """What an embedding model wants before a text; side is query or document."""
    name = F.lower(model)
    if side == "query":
        return F.when(name.contains("nomic"), "search_query: ").when(name.contains("mxbai"), "Represent this sentence for searching relevant passages: ").otherwise("")
    return F.when(name.contains("nomic"), "search_document: ").otherwise("")


def embed_query(c: Column, model: Column, most: int = 500) -> Column:
    return F.concat(model_prefix(model, "query"), F.substring(refine_query(c), 1, most))


def chunk_hash(c: Column) -> Column:
    """Equality key of an embedded text."""
    return F.sha2(c, 256)


def snake_tag(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(c: Column, default: str = "Concept") -> Column:
    name = F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', ""))
    return F.when(name == "", default).otherwise(name)


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with ${name} replaced, one name after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), value)
    return out


def json_path(c: Column, path: str, most: int = 3000, keep: int = 2950) -> Column:
    """Value at a dot path with [n], as text; null on any miss; long values cut and marked."""
    return truncate_mark(F.get_json_object(c, f"$.{path}"), most, keep, "\n\n...[TRUNCATED]")


def truncate_mark(c: Column, most: int, keep: int, mark: str) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep), F.lit(mark))).otherwise(c)


_FRONT = {"start": r"\A---\n[\s\S]*?\n---\n?", "crlf": r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", "any": r"(?m)^---[\s\S]*?---\s*"}


def strip_front_matter(c: Column, form: str = "crlf") -> Column:
    """Text without its front matter; form: start, crlf (start too, either line end) or any (a pair of rules at a line's start)."""
    return F.regexp_replace(c, _FRONT[form], "") if form != "any" else F.regexp_replace(c, _FRONT["any"], "")


def set_front_matter_field(c: Column, key: str, value: Column, least_body: int = 50) -> Column:
    """The text with a front matter field replaced, appended or, without front matter, made; unchanged if the body is too short."""
    block = F.regexp_extract(c, r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n?", 1)
    has = c.rlike(r"\A---\r?\n[\s\S]*?\r?\n---")
    rest = strip_front_matter(c)
    line = F.concat(F.lit(f"{key}: \""), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))
    pattern = rf"(?m)^{re.escape(key)}:.*$"
    # The new line may hold characters that a replacement string would read; the parts around the old one are joined instead.
    old = F.regexp_extract(block, pattern, 0)
    at = F.locate(old, block) if isinstance(old, str) else F.call_function("locate", old, block)
    new = F.concat(F.substring(block, F.lit(1), at - 1), line, F.substring(block, at + F.length(old), F.length(block)))
    found = block.rlike(pattern)
    made = F.when(has & found, F.concat(F.lit("---\n"), new, F.lit("\n---\n"), rest)).when(has, F.concat(F.lit("---\n"), block, F.lit("\n"), line, F.lit("\n---\n"), rest))
    return F.when(F.length(F.trim(rest)) < least_body, c).otherwise(made.otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), c)))
