"""Pages written by hand, and the blocks of their main text. None comes from the grammar that the model learns from."""

NAV = '<nav><a href="/">Home</a> <a href="/about">About us</a> <a href="/contact">Contact</a></nav>'
FOOT = "<footer><p>&copy; 2021 The Gazette. All rights reserved.</p></footer>"
A = "The river rose by two metres overnight, and the lower road has been closed since dawn."
B = "Engineers expect the water to fall by the weekend. Until then buses take the hill road."
C = "Nobody was hurt."
D = "Anna Berg, who has run the mill for thirty years, said she had never seen anything like it; her cellar filled within an hour."


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def li(*texts):
    return "".join(f"<li>{t}</li>" for t in texts)


PAGES = [
    # bare bodies
    (f"<html><body>{p(A)}</body></html>", [A]),
    (f"<html><body><h1>Flood</h1>{p(A)}</body></html>", ["Flood", A]),
    (f"<html><body><h1>Flood</h1>{p(A, B, D)}</body></html>", ["Flood", A, B, D]),
    (f"<body><h1>Flood</h1>{p(A, B, C, D, A, B, D, B, A, D)}</body>", ["Flood", A, B, C, D, A, B, D, B, A, D]),
    (p(A), [A]),
    (p(A, B), [A, B]),
    (A, [A]),
    (f"{A}\n{B}", [f"{A} {B}"]),
    (f"<h2>Notes</h2>{p(A)}<ul>{li('bread', 'milk', 'two dozen eggs')}</ul>", ["Notes", A, "bread", "milk", "two dozen eggs"]),
    (f"<html><body>{p(A)}<hr>{p(B)}<blockquote>{D}</blockquote></body></html>", [A, B, D]),
    (f"<html><body>{NAV}<h1>Flood</h1>{p(A, B, D)}</body></html>", ["Flood", A, B, D]),
    (f"<html><body>{NAV}<h1>Flood</h1>{p(A, D, B)}{FOOT}</body></html>", ["Flood", A, D, B]),
    ("<html><body><pre>x = 1\ny = 2</pre></body></html>", ["x = 1 y = 2"]),
    (f"<html><body><center><h1>My page</h1></center>{p(A, D)}</body></html>", ["My page", A, D]),
    # articles
    (f"<html><body><article>{p(A)}</article></body></html>", [A]),
    (f"<html><body>{NAV}<article><h1>Flood</h1>{p(A, B)}</article>{FOOT}</body></html>", ["Flood", A, B]),
    (f"<html><body>{NAV}<article><h1>Flood</h1>{p(C)}</article></body></html>", ["Flood", C]),
    (f"<html><body><article>{p(A)}<ul>{li('<a href=/1>First report</a>')}</ul></article></body></html>", [A, "First report"]),
    (f"<html><body><article>{p(A, B)}<ul>{li('<a href=/1>First report</a>', '<a href=/2>Map of the valley</a>', '<a href=/3>How dams work</a>')}</ul></article></body></html>", [A, B, "First report", "Map of the valley", "How dams work"]),
    (f"<html><body>{NAV}<article><h1>Sources</h1>{p(A)}<ol>" + li(*(f"<a href='/{i}'>Report number {i} of the commission</a>" for i in range(12))) + f"</ol></article>{FOOT}</body></html>", ["Sources", A, *(f"Report number {i} of the commission" for i in range(12))]),
    (f"<html><body><article><h2>On this page</h2><ul>{li('<a href=#a>Water</a>', '<a href=#b>Roads</a>')}</ul><h2>Water</h2>{p(A)}<h2>Roads</h2>{p(B)}</article></body></html>", ["On this page", "Water", "Roads", "Water", A, "Roads", B]),
    (f"<html><body>{NAV}<article><h1>Levels</h1><table><tr><td>Monday</td><td>2.1 m</td></tr><tr><td>Tuesday</td><td>3.9 m</td></tr></table>{p(B)}</article></body></html>", ["Levels", "Monday", "2.1 m", "Tuesday", "3.9 m", B]),
    (f"<html><body><article><h1>Soup</h1>{p('Serves four.')}<h2>You need</h2><ul>{li('1 onion', '2 carrots', 'salt')}</ul><h2>Method</h2><ol>{li('Chop it all.', 'Boil for an hour.', 'Eat.')}</ol></article></body></html>", ["Soup", "Serves four.", "You need", "1 onion", "2 carrots", "salt", "Method", "Chop it all.", "Boil for an hour.", "Eat."]),
    (f"<html><body>{NAV}<article>{p(A, D)}<figure><img src=x.jpg><figcaption>The mill this morning</figcaption></figure>{p(B)}</article></body></html>", [A, D, "The mill this morning", B]),
    (f"<html><body><article class='post'><header><h1>Flood</h1></header>{p(A, B)}</article><section class='comments'><h2>Comments</h2><p>So sad to read this.</p></section></body></html>", ["Flood", A, B]),
    (f"<html><body><article>{p(A)}<div class='ad'>Buy boots now!</div>{p(B)}</article></body></html>", [A, B]),
    (f"<html><body><article>{p(A, B)}<form action='/s'><label>Your mail</label><input><button>Sign up</button></form></article></body></html>", [A, B]),
    (f"<html><body><article><p><b>Flood.</b> {A}<br>{B}</p></article></body></html>", [f"Flood. {A} {B}"]),
    # main elements and named blocks
    (f"<html><body><header><a href='/'>The Gazette</a></header><main><h1>Flood</h1>{p(A, D)}</main>{FOOT}</body></html>", ["Flood", A, D]),
    (f"<html><body>{NAV}<main>{p(C)}</main></body></html>", [C]),
    (f"<html><body><div id='header'><h1>The Gazette</h1></div><div id='menu'><ul>{li('<a href=/>Home</a>', '<a href=/n>News</a>')}</ul></div><div id='content'><h2>Flood</h2>{p(A, B)}</div><div id='footer'>Made by hand</div></body></html>", ["Flood", A, B]),
    (f"<html><body><div class='wrapper'><div class='sidebar'><h3>More</h3><ul>{li('<a href=/x>Fire</a>', '<a href=/y>Storm</a>')}</ul></div><div class='post-content'>{p(A, B, D)}</div></div></body></html>", [A, B, D]),
    (f"<html><body><div class='container'><div class='entry'><h1>Flood</h1>{p(A)}</div><div class='comments'><p>First!</p><p>I live there. Stay safe all of you.</p></div></div></body></html>", ["Flood", A]),
    (f"<html><body><div class='cookie-banner'><p>We use cookies. Do you agree?</p><button>Yes</button></div><div class='article-body'>{p(A, D)}</div></body></html>", [A, D]),
    (f"<html><body><div role='main'><h1>Flood</h1>{p(A)}<dl><dt>Gauge</dt><dd>A stick with marks.</dd></dl></div><div role='navigation'><a href='/'>Home</a></div></body></html>", ["Flood", A, "Gauge", "A stick with marks."]),
    (f"<html><body><section class='story'>{p(A, B)}<aside class='related'><h4>Related</h4><a href='/q'>Dams of the north</a></aside>{p(D)}</section></body></html>", [A, B, D]),
    # without names, and tables
    (f"<html><body><div><a href='/'>Home</a> | <a href='/n'>News</a></div><div><h1>Flood</h1>{p(A, B, D)}</div><div><p>&copy; 2020 Someone</p></div></body></html>", ["Flood", A, B, D]),
    (f"<html><body><div><div><h1>Flood</h1>{p(A, B, A, D)}</div></div></body></html>", ["Flood", A, B, A, D]),
    (f"<html><body><table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td><h2>Flood</h2>{p(A, B)}</td></tr></table></body></html>", ["Flood", A, B]),
    (f"<html><body bgcolor=white><table width=100%><tr><td colspan=2><h1>The Gazette</h1></td></tr><tr><td><a href=/>Home</a><br><a href=/b>Sports</a></td><td>{p(A, D, B)}</td></tr><tr><td colspan=2>Copyright 1998</td></tr></table></body></html>", [A, D, B]),
    (f"<html><body><div>{A}</div><div>{B}</div><div>{D}</div></body></html>", [A, B, D]),
    # broken and odd
    (f"<html><body><article><p>{A}<p>{B}<p>{D}</article>", [A, B, D]),
    (f"<article>{p('caf&eacute; &amp; bar', A)}", ["café & bar", A]),
    (f"<!doctype html><title>Flood</title><script>var a = '<p>no</p>'</script><h1>Flood</h1>{p(A)}<style>p {{}}</style>", ["Flood", A]),
    (f"<html><head><title>x</title></head><body>{NAV}{NAV}<article><h1>流れ</h1>{p('川の水は一晩で二メートル上がった。', '下の道は閉ざされている。')}</article></body></html>", ["流れ", "川の水は一晩で二メートル上がった。", "下の道は閉ざされている。"]),
]
