"""Labelled pages; <!--main--> and <!--/main--> enclose the main text. The weights of ``htmlmain`` are learned from these: a few written ones, and\nthe combinations of page frames with main texts of several kinds."""

_TEXT = (
    "The harbour lay quiet while the last boats came home and the men on the quay counted their nets.",
    "Nobody had expected the storm to turn so early in the year, and few houses were ready for it.",
    "In the morning the council met again to speak about the new wall and about who should pay for it.",
    "A second plan, cheaper but slower, found more friends than the first one, and work began in spring.",
)


def _page(*parts: str) -> str:
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Page</title></head><body>" + "".join(parts) + "</body></html>"


def _menu(*names: str) -> str:
    return "<nav><ul>" + "".join(f"<li><a href='/{n}'>{n}</a></li>" for n in names) + "</ul></nav>"


def _paragraphs(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


_WRITTEN = (
    _page(_menu("Home", "News", "Sport"), "<!--main--><article><h1>The quiet harbour</h1>", _paragraphs(*_TEXT), "</article><!--/main-->", "<footer><p>All rights reserved</p></footer>"),
    _page("<div><a href='/'>Logo</a><a href='/in'>Sign in</a></div>", "<div><!--main--><h2>Council</h2>", _paragraphs(*_TEXT[1:]), "<ul><li>The wall costs more than all the boats.</li><li>The road is closed until the work is done.</li></ul><!--/main--></div>", "<div><ul><li><a href='/a'>Older story</a></li><li><a href='/b'>Newer story</a></li></ul></div>"),
    _page("<header><h1>Daily</h1></header>", _menu("Start", "Archive", "About"), "<main><!--main-->", _paragraphs(*_TEXT[:3]), "<blockquote><p>We will build it <b>ourselves</b>, said the oldest of the men, and <i>nobody</i> laughed.</p></blockquote><!--/main--></main>", "<aside><h3>Related</h3><a href='/x'>More</a><a href='/y'>Less</a></aside>", "<form><label>Mail</label><input><button>Send</button></form>"),
    _page("<table><tr><td><a href='/1'>One</a></td><td><a href='/2'>Two</a></td></tr></table>", "<div><!--main-->", _TEXT[0], "<br>", _TEXT[2], "<br>", _TEXT[3], "<!--/main--></div>", "<div><p><a href='/terms'>Terms</a> <a href='/privacy'>Privacy</a></p></div>"),
)

#: What stands before and after the main text in pages of different make.
_FRAMES = (
    (_menu("Home", "News", "Sport", "Culture") + "<div><article>", "</article></div><div><p>Copyright</p><a href='/a'>Imprint</a> <a href='/b'>Contact</a></div>"),
    ("<div><img src='logo.png'><a href='/'>Start</a><a href='/in'>Sign in</a><hr></div><div>", "</div><ul><li><a href='/1'>First teaser of the day</a></li><li><a href='/2'>Second teaser</a></li></ul>"),
    ("<header><h1>Daily</h1></header><main>", "</main><aside><h3>Related</h3><ul><li><a href='/x'>More</a></li><li><a href='/y'>Less</a></li></ul></aside>"),
    ("<table><tr><td><a href='/1'>One</a></td><td><a href='/2'>Two</a></td></tr></table><div>", "</div><form><label>Mail</label><input><button>Send</button></form><footer><p>All rights reserved</p></footer>"),
    ("<div><ul><li><a href='/p'>Products</a></li><li><a href='/s'>Service</a></li></ul><span>Menu</span></div><section>", "</section><div><a href='/prev'>Back</a><a href='/next'>Next</a></div>"),
)
#: Main texts of several kinds.
_MAINS = (
    _paragraphs(*_TEXT),
    f"<h2>Council</h2><p>{_TEXT[0]}</p><img src='a.png'><hr>" + _paragraphs(*_TEXT[1:]),
    f"<h1>Prices</h1><p>{_TEXT[1]}</p><table><tr><th>Fish</th><th>Price of the day</th></tr><tr><td>Herring from the bay</td><td>two crowns</td></tr></table><p>{_TEXT[2]}</p>",
    f"<p>{_TEXT[3]}</p><ul><li><a href='/plan'>The plan</a> as the council wrote it</li><li>The <a href='/map'>map</a> of the new wall</li></ul><h3>Later</h3><p>{_TEXT[0]}</p>",
    f"{_TEXT[0]}<br><br>{_TEXT[1]}<br><b>Then</b> {_TEXT[2]}<br>{_TEXT[3]}",
    f"<blockquote><p>{_TEXT[2]}</p></blockquote><p><i>{_TEXT[0]}</i></p><pre>low water 6.10, high water 12.25</pre><p>{_TEXT[1]} <a href='/more'>See the tables</a></p>",
)

PAGES = _WRITTEN + tuple(_page(before, "<!--main-->", main, "<!--/main-->", after) for before, after in _FRAMES for main in _MAINS)
