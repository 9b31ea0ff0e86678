"""Main text of short, unpunctuated and non-Latin articles, alone and framed, and of hand-written pages in several languages."""

import pytest

from riskloom.llm import extraction

MENU = '<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Example. All rights reserved.</p></footer>"
TEXTS = {
    "three plain words": "three plain words", "one two three four five six": "one two three four five six", "12 34 56 78": "12 34 56 78", "Tom &amp; Jerry &copy; &#x41; a": "Tom & Jerry © A a",
    "x = f(y); return x": "x = f(y); return x", "今天天气很好，我们去公园散步。晚上一起吃饭吧！": "今天天气很好，我们去公园散步。晚上一起吃饭吧！", "Tom and Jerry went home.": "Tom and Jerry went home.",
    "<a href=/x>A link</a> in front of the text of this page.": "A link in front of the text of this page.", "нет знаков препинания": "нет знаков препинания", "آج موسم اچھا ہے۔": "آج موسم اچھا ہے۔",
}
FRAMES = ["<p>%s</p>", "<html><body><article><p>%s</p></article></body></html>", "<html><body><div><p>%s</p></div></body></html>", f"<html><body>{MENU}<article><p>%s</p></article>{FOOT}</body></html>", f"<body>{MENU}<div><p>%s</p></div>{FOOT}</body>"]


@pytest.mark.parametrize("frame", FRAMES)
def test_short_articles_are_kept(frame):
    assert extraction.default_extractor().extract([frame % t for t in TEXTS]) == list(TEXTS.values())


def test_pages_without_an_article_are_empty():
    pages = [MENU + FOOT, f"<body>{MENU}</body>", f"<body><div class=x>{MENU}</div></body>", "<body><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></body>", "<form><p>Your name please.</p><input></form>", "", None]
    assert extraction.default_extractor().extract(pages) == [""] * len(pages)


#: Hand-written pages; lines of main text stand between [ and ].
PAGES = [
    "<body><header><div class=logo>Tagblatt</div></header><main><h1>[Neue Brücke eröffnet]</h1><p>[Die Stadt hat am Montag eine neue Brücke über den Fluss eröffnet.]</p><p>[Sie kostete zwölf Millionen.]</p></main><aside class=related><h3>Mehr</h3><ul><li><a href=/1>Wetter</a></li><li><a href=/2>Sport heute</a></li></ul></aside></body>",
    "<body><div class=navbar><a href=/>Accueil</a> | <a href=/b>Culture</a> | <a href=/c>Vie</a></div><article><h1>[Le pain de campagne]</h1><p>[Mélangez la farine, l'eau et le sel.]</p><ul><li>[500 g de farine]</li><li>[Une pincée de sel]</li></ul></article><div class=footer>Mentions légales &middot; Tous droits réservés.</div></body>",
    "<body><nav><a href=/>Inicio</a> <a href=/n>Noticias</a></nav><div id=content><h2>[El puerto cierra]</h2><p>[El puerto cerró por el viento.]</p><p>[Los barcos esperan fuera.]</p></div><section class=comments><h3>Comentarios</h3><div class=comment><p>¡Qué pena! Yo iba hoy.</p></div></section></body>",
    "<body><div class=menu><ul><li><a href=/>首页</a></li><li><a href=/n>新闻</a></li></ul></div><div class=article><h1>[城市新桥通车]</h1><p>[星期一，新桥正式通车。市民很高兴。]</p><p>[工程历时三年。]</p></div><div class=footer>版权所有 2024</div></body>",
    "<body><header class=masthead><div>ニュース</div></header><article><h1>[桜が咲いた]</h1><p>[今年は例年より早く桜が咲きました。公園は人でいっぱいです。]</p></article><aside class=sidebar><h3>人気</h3><ul><li><a href=/1>天気</a></li><li><a href=/2>野球</a></li></ul></aside></body>",
    "<body><nav class=nav><ul><li><a href=/>Главная</a></li><li><a href=/x>Спорт</a></li></ul></nav><main><h1>[Открыт новый мост]</h1><p>[В понедельник в городе открыли новый мост.]</p><blockquote><p>[Мы ждали этого десять лет.]</p></blockquote></main><footer>Все права защищены.</footer></body>",
    "<body><div class=cookie-notice><p>We use cookies to improve your visit. You may refuse them.</p><button>OK</button></div><article class=post><h1>[Notes on tea]</h1><p>[Water should not boil.]</p><table><tr><td>[Green tea]</td><td>[80 degrees]</td></tr></table></article></body>",
    "<body><div class=topbar><p>Call us today</p></div><section class=story><p>[It rained for a week and the mill stood still.]</p><div class=ad><p>Buy two boots, get one free!</p></div><p>[On the eighth day the sun came out.]</p></section></body>",
    "<body><ul class=breadcrumbs><li><a href=/>Start</a></li><li><a href=/k>Kultur</a></li></ul><div role=main><h1>[Konsten i norr]</h1><p>[Museet visar hundra målningar från norra Sverige.]</p></div><div class=newsletter><p>Få nyheter varje vecka.</p><form><input><button>Skicka</button></form></div></body>",
    "<body><table><tr><td class=nav><a href=/a>Um</a><br><a href=/b>Dois</a><br><a href=/c>Três</a></td><td class=content><h2>[A feira]</h2><p>[A feira abre aos sábados e fecha às duas.]</p><p>[Leve troco.]</p></td></tr></table></body>",
    "<body><div class=wrapper><article><header><h1>[Ricetta semplice]</h1></header><p>[Cuocere la pasta per nove minuti.]</p><figure><img src=p><figcaption>[La pasta nel piatto.]</figcaption></figure></article><div class=share><a href=/f>Uno</a> <a href=/t>Due</a></div></div></body>",
    "<body><main><p>[버스 노선이 바뀌었습니다. 자세한 내용은 아래와 같습니다.]</p><ul><li>[1번은 시청을 지납니다.]</li><li>[2번은 운행하지 않습니다.]</li></ul></main><div class=widget><h3>링크</h3><ul><li><a href=/1>지도</a></li><li><a href=/2>요금</a></li></ul></div></body>",
]


def test_hand_written_pages():
    """Every line of main text is found, and at most one page in twelve keeps a line more."""
    pages = [p.replace("[", "").replace("]", "") for p in PAGES]
    want = [[line.split("]")[0] for line in p.split("[")[1:]] for p in PAGES]
    got = [t.split("\n") if t else [] for t in extraction.default_extractor().extract(pages)]
    found = sum(w in g for ws, g in zip(want, got, strict=True) for w in ws)
    extra = sum(g not in ws for ws, gs in zip(want, got, strict=True) for g in gs)
    assert found == sum(map(len, want)), [(w, g) for w, g in zip(want, got, strict=True) if w != g]
    assert extra <= 1, [(w, g) for w, g in zip(want, got, strict=True) if w != g]
