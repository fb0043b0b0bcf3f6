"""The scan of pages against one regular expression that says what it finds, and its time on broken pages."""

import random
import re
import time

import pytest

from ragloom.llm import html_blocks

PLAIN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <svg\b(?:"[^"]*+"|'[^']*+'|[^>"'])*+(?<=/)>
      | <(?P<raw>script|style|template|textarea|title|iframe)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)
      | <svg\b[^>]*+>(?:(?!<(?:p|div|h[1-6]|[uod]l|li|d[dt]|table|pre|blockquote|body|span)\b).)*?</svg\s*+>
      | <select\b[^>]*+>(?:(?!<(?:select|input|textarea)\b).)*?</select\s*+>
      | <noscript\b[^>]*+>(?:(?!<noscript\b).)*?</noscript\s*+>
      | <(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)>
      | <[!?/][^>]*+>
      | (?P<text>[^<]++|<)
    """,
    re.S | re.I | re.X,
)
PIECES = """<svg> <svg/> <svg a="/"> <SVG </svg> </svg > <p> </p> <p a='>'> <a <a> </a </a> <b " ' > < / <!-- --> <!doctype> <?x> </ <script> </script> <title> </TITLE > <select> <input> </select>
<noscript> </noscript> text & é \n = <iframe <style/> <h1> <svg-x> <x:y z="<" >""".split(" ")


def test_same_tokens():
    r = random.Random(4)
    for _ in range(30_000):
        source = "".join(r.choice(PIECES) + r.choice(["", "", " "]) for _ in range(r.randrange(14)))
        expected = [(m["text"], m["tag"] or "", m["close"] or "", m["attributes"] or "") for m in PLAIN.finditer(source) if m["text"] is not None or m["tag"] is not None]
        assert list(html_blocks._Scan(source).tokens()) == expected, source


@pytest.mark.parametrize("piece", ["<svg>", "<svg ", "<a ", "</a", '<b "', "<b '", "<b \"'", "<!--", "<script>", "<select>", "<noscript>", "<title", "<", "<!", "<svg><a ", '<svg "', "<p a=\"<'", "<div><b>", "</svg "])
def test_a_megabyte_of_broken_markup(piece):
    source = piece * (1_000_000 // len(piece))
    for page in (source, source + "<p>end</p>", source + '">' + "'>"):
        began = time.perf_counter()
        tokens = len(html_blocks.blocks(page))
        assert tokens >= 0 and time.perf_counter() - began < 4
