"""Self-closed, unclosed and deep markup."""

from ragloom.llm.html_blocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


def test_self_closed_and_unclosed_elements_keep_what_follows():
    assert texts('<article><svg class="i"/><p>first</p><p>second</p></article>') == ["first", "second"]
    assert texts("<p>a<svg><path d='x'/><text>no</text></svg>b</p>") == ["ab"]
    assert texts("<svg><g><p>one</p><svg><text>no</text></svg><p>two") == ["one", "two"]
    assert texts("<select><option>x<p>one</p><p>two</p>") == ["x", "one", "two"]
    assert texts("<noscript><p>one</p><p>two</p>") == ["one", "two"]
    assert texts("<select><option>no</select><noscript>no</noscript><p>yes") == ["yes"]
    assert texts("<p>yes<script>no") == ["yes"]


def test_deep_markup_closes_its_own_tags():
    depth = 300
    found = blocks("<main><div>" + "<div>" * depth + "deep" + "</div>" * depth + "<p>outer</p></div></main><p>after")
    plain = blocks("<main><div><p>outer</p></div></main><p>after")
    assert [b.text for b in found] == ["deep", "outer", "after"]
    assert [b.path for b in found[1:]] == [b.path for b in plain]
