"""Comments and literals of code as blanks, and the names called outside of them; no Python runs.

One pattern of possessive alternatives cuts a text into plain pieces, comments and literals, so the
text is read once, from left to right, whatever it holds; no group of it calls itself for each
character, so very long texts neither overflow the stack nor go back.  A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C_PIECES = r"""(?s)//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)|[^/"']++|/"""
RUST_LITERALS = r"""(?s)r#".*?"#|r"[^"]*+"|"(?:[^"\\]++|\\[^\n])*+"|'(?:\\[^\n]|[^'\\])'"""
NO_TEXT = "\U0010ffff"  # a noncharacter: no text holds it

# Names before a parenthesis that are no calls (C), or no calls of a user's function unless the file defines one (Python).
NO_CALLS = {
    "c": ("if", "while", "for", "switch", "return", "sizeof", "typeof", "alignof", "offsetof", "case", "else"),
    "ruby": ("if", "unless", "while", "until", "for", "case", "when", "begin", "rescue", "ensure", "end", "def", "class", "module", "do", "return", "yield"),
}
CALL = {"ruby": r"\b([a-zA-Z_][a-zA-Z0-9_!?]*)\s*\("}
ANY_CALL = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
PYTHON_OWN = tuple("""
print len range str int float bool list dict set tuple type isinstance issubclass hasattr getattr setattr delattr callable super next iter enumerate
zip map filter sorted reversed min max sum abs round pow divmod hex oct bin ord chr ascii repr format hash id input open eval exec compile
globals locals vars dir help exit quit staticmethod classmethod property object Exception BaseException ValueError TypeError KeyError IndexError
AttributeError RuntimeError StopIteration NotImplementedError
json os sys re datetime time math random collections itertools functools operator copy pickle shelve sqlite3 csv io pathlib shutil subprocess
threading multiprocessing asyncio socket http urllib email html xml logging unittest typing dataclasses contextlib abc inspect traceback
""".split())


def blanked_c(code: Column) -> Column:
    """Each character of a comment or literal as a blank; line breaks stay, but for an escaped one in a literal.

    What is opened and not closed reaches to the end of the text."""
    def blank(piece: Column) -> Column:
        literal = F.regexp_replace(F.regexp_replace(piece, r"(?s)\\.", "  "), r"[^\n]", " ")
        return F.when(piece.rlike(r"\A//") | piece.rlike(r"\A/\*"), F.regexp_replace(piece, r"[^\n]", " ")).when(piece.rlike(r"""\A["']"""), literal).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(code, F.lit(C_PIECES), F.lit(0)), blank), "")


def blanked_rust(code: Column) -> Column:
    """Each closed literal as one blank: "…", '…' of one character, r"…", r#"…"#; the rest, and what is not closed, stays.

    Openings of r#"…"# behind the last close are marked first: a flood of them would each search to the end."""
    at = F.locate('#"', F.reverse(code))
    closed = F.when(at > 0, F.length(code) - at + 1).otherwise(0)
    tail = F.replace(F.substring(code, closed + 1, F.length(code)), F.lit('r#"'), F.lit(f'r{NO_TEXT}#"'))
    return F.replace(F.regexp_replace(F.concat(F.substring(code, F.lit(1), closed), tail), RUST_LITERALS, " "), F.lit(NO_TEXT), F.lit(""))


def called_names(code: Column, language: str = "c") -> Column:
    """Names before a parenthesis, once each in order of their first place, less the language's own words.

    Comments and literals of C do not count; Python and Ruby are read as they stand."""
    found = F.array_distinct(F.regexp_extract_all(blanked_c(code) if language == "c" else code, F.lit(CALL.get(language, ANY_CALL)), F.lit(1)))
    words = NO_CALLS.get(language)
    return F.array_except(found, F.array(*map(F.lit, words))) if words else found
