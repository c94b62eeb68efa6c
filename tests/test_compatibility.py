"""Compatibility cases: markup, expression, and the matches in document order with byte spans."""

import pytest

from markgrove.api import query

#: Fixed values: (category, expression, markup, matches as name[start,end], attributes as @name=value).
CASES = [
    ('basic', '//div', '<html><body><div>Hello</div><p>World</p></body></html>', 'div[12,28]'),
    ('basic', '/html', '<html><head><title>Test</title></head><body><div>Content</div></body></html>', 'html[0,76]'),
    ('basic', '/html/body/p', '<html><body><div><p>Nested</p></div><p>Top level</p></body></html>', 'p[36,52]'),
    ('attributes', "//div[@id='test']", "<html><body><div id='test' class='highlight'>Content</div><div class='other'>Other</div></body></html>", 'div[12,58]'),
    ('attributes', '//div[@id]', "<html><body><div id='test'>With ID</div><div>Without ID</div></body></html>", 'div[12,40]'),
    ('attributes', '//div[@id and @class]', "<html><body><div id='test' class='highlight'>Both</div><div id='other'>ID only</div><div class='highlight'>Class only</div></body></html>", 'div[12,55]'),
    ('text', "//p[text()='Second']", '<html><body><p>First</p><p>Second</p><p>Third</p></body></html>', 'p[24,37]'),
    ('text', '//p[text()]', '<html><body><p>Has text</p><p></p><p>Also has text</p></body></html>', 'p[12,27]; p[34,54]'),
    ('text', "//p[contains(text(), 'quick')]", '<html><body><p>The quick brown fox</p><p>Lazy dog sleeping</p><p>Quick silver</p></body></html>', 'p[12,38]'),
    ('position', '//li[position()=2]', '<html><body><ul><li>Item 1</li><li>Item 2</li><li>Item 3</li></ul></body></html>', 'li[31,46]'),
    ('position', '//li[last()]', '<html><body><ul><li>First</li><li>Middle</li><li>Last</li></ul></body></html>', 'li[45,58]'),
    ('position', '//li[3]', '<html><body><ol><li>One</li><li>Two</li><li>Three</li><li>Four</li></ol></body></html>', 'li[40,54]'),
    ('axes', '//div//a', "<html><body><div><span><a href='#'>Link</a></span></div><a href='#'>Top link</a></body></html>", 'a[23,43]'),
    ('axes', "//p[@id='child']/parent::div", "<html><body><div><p id='child'>Child</p></div></body></html>", 'div[12,46]'),
    ('axes', '//h1/following-sibling::p', '<html><body><div><h1>Title</h1><p>First para</p><p>Second para</p></div></body></html>', 'p[31,48]; p[48,66]'),
    ('axes', '//h2/preceding-sibling::p', '<html><body><div><p>Before</p><h2>Header</h2><p>After</p></div></body></html>', 'p[17,30]'),
    ('axes', "//div[@id='target']/self::div", "<html><body><div id='target'>Self</div></body></html>", 'div[12,39]'),
    ('complex', "//div[@class='red' or @class='blue']", "<html><body><div class='red'>Red</div><div class='blue'>Blue</div><div class='green'>Green</div></body></html>", 'div[12,38]; div[38,66]'),
    ('complex', "//div[@id='test'][@class='active']", "<html><body><div id='test' class='active'>Target</div><div id='other' class='active'>Other</div><div id='test'>Inactive</div></body></html>", 'div[12,54]'),
    ('complex', "//li[span[text()='Second']]", '<html><body><ul><li><span>First</span></li><li><span>Second</span></li></ul></body></html>', 'li[43,71]'),
    ('wildcard', "//*[@class='highlight']", "<html><body><div class='highlight'>Div</div><p class='highlight'>Para</p><span>Span</span></body></html>", 'div[12,44]; p[44,73]'),
    ('union', '//h1 | //h2', '<html><body><h1>Header</h1><p>Para</p><h2>Subheader</h2></body></html>', 'h1[12,27]; h2[38,56]'),
    ('attributes', '//div/@class', "<html><body><div id='test' class='highlight' data-value='123'>Content</div></body></html>", '@class=highlight'),
    ('attributes', '//input/@*', "<html><body><input type='text' name='username' required /></body></html>", '@type=text; @name=username; @required='),
    ('functions', '//body/node()', '<html><body><!-- Comment --><div>Element</div>Text node</body></html>', '#comment[12,28]; div[28,46]; #text[46,55]'),
    ('functions', '//ul[count(li)=3]', '<html><body><ul><li>A</li><li>B</li><li>C</li></ul></body></html>', 'ul[12,51]'),
    ('functions', '//p[string-length(text())>10]', '<html><body><p>Short</p><p>This is a longer paragraph</p></body></html>', 'p[24,57]'),
    ('functions', "//a[starts-with(@href, 'https')]", "<html><body><a href='https://example.com'>HTTPS</a><a href='http://test.com'>HTTP</a></body></html>", 'a[12,51]'),
    ('functions', "//p[normalize-space(text())='Lots of spaces']", '<html><body><p>  Lots   of    spaces  </p><p>Normal text</p></body></html>', 'p[12,42]'),
    ('complex', '//article//section//p[not(ancestor::aside)]', '<html><body><article><header><h1>Title</h1></header><section><p>Content</p><aside><p>Sidebar</p></aside></section></article></body></html>', 'p[61,75]'),
    ('complex', '//table//tr[2]/td[1]', '<html><body><table><tr><td>A1</td><td>B1</td></tr><tr><td>A2</td><td>B2</td></tr></table></body></html>', 'td[54,65]'),
    ('forms', "//form//input[@type='text']", "<html><body><form><input type='text' name='user'/><input type='password' name='pass'/><button type='submit'>Login</button></form></body></html>", 'input[18,50]'),
    ('real-world', "//ul[@class='menu']/li[@class='active']", "<html><body><ul class='menu'><li class='active'>Home</li><li>About</li><li class='active'>Contact</li></ul></body></html>", 'li[29,57]; li[71,102]'),
    ('real-world', '//nav//li[not(a)]', "<html><body><nav><ol><li><a href='/'>Home</a></li><li><a href='/products'>Products</a></li><li>Current Page</li></ol></nav></body></html>", 'li[91,112]'),
    ('attributes', "//div[@data-type='product']", "<html><body><div data-id='123' data-type='product'>Product</div><div data-id='456' data-type='category'>Category</div></body></html>", 'div[12,64]'),
    ('edge-cases', '//div[not(node())]', '<html><body><div></div><div>Content</div><div><span></span></div></body></html>', 'div[12,23]'),
    ('attributes', "//div[contains(@class, 'btn-primary')]", "<html><body><div class='btn btn-primary btn-large'>Button</div><div class='btn btn-secondary'>Other</div></body></html>", 'div[12,63]'),
    ('edge-cases', "//p[contains(text(), '世界')]", '<html><body><p>Hello 世界</p><p>Emoji 🌍</p><p>Math ∑∆∇</p></body></html>', 'p[12,31]'),
    ('edge-cases', "//p[@class='text'][ancestor::section[@class='content']]", "<html><body><main><article><section class='content'><div><p class='text'>Target</p></div></section></article><aside><section class='sidebar'><div><p class='text'>Skip</p></div></section></aside></main></body></html>", 'p[57,83]'),
    ("edge-cases", "//div[not(node())]", "<div></div>", "div[0,11]"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, c[2]) for i, c in enumerate(CASES)], "doc_id int, html string")


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{i}-{CASES[i][0]}")
def test_case(table, i):
    _, xpath, _, expected = CASES[i]
    columns = ["ord", "node_name", "node_type", "text_content", "start_location", "end_location"]
    rows = query(xpath, table.where(f"doc_id = {i}"), columns=columns).orderBy("ord").collect()
    shown = [f"@{r.node_name}={r.text_content}" if r.node_type == 2 else f"{r.node_name}[{r.start_location},{r.end_location}]" for r in rows]
    assert "; ".join(shown) == expected
    assert [r.ord for r in rows] == list(range(1, len(rows) + 1))
    assert all((r.start_location, r.end_location) == (0, 0) for r in rows if r.node_type == 2)
