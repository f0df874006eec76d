"""Pages written by hand, none of them made by the training generator, and the blocks of their articles."""

P = [
    "The council voted on Tuesday to close the old bridge for repairs that will last until spring.",
    "Engineers found cracks in two of the pillars last year, and traffic has been limited since then.",
    "Buses will take a longer way round, which adds some ten minutes to a journey into the centre.",
    "Shop owners near the bridge fear that fewer people will pass, and ask for help with their rent.",
]

NEWS = f"""<!doctype html><html lang=en><head><title>Bridge closes - The Daily</title><meta name=x content="y"><link rel=stylesheet href=a.css></head><body class="home single">
<div id="top-bar"><a href="/login">Log in</a> <a href="/sub">Subscribe</a></div><header class="site-header"><a class="logo" href="/">The Daily</a><nav class="main-nav"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main id="main"><article class="story" data-year="2020" data-y="x"><h1>Old bridge closes for repairs</h1><p class="lead">{P[0]}</p><p>{P[1]}</p><aside class="ad-slot">Advertisement</aside><p>{P[2]}</p><h2>What shops say</h2><p>{P[3]}</p></article></main>
<aside class="sidebar"><h3>Most read</h3><ol><li><a href="/1">Cat found on roof</a></li><li><a href="/2">Rain all week</a></li></ol></aside><footer class="site-footer"><p>&copy; 2020 The Daily. All rights reserved.</p><ul><li><a href="/t">Terms</a></li></ul></footer></body></html>"""
NEWS_WANT = ["Old bridge closes for repairs", P[0], P[1], P[2], "What shops say", P[3]]

BLOG = f"""<html><head><title>My garden</title></head><body><div id="page" class="hfeed site"><div id="header"><h1 class="site-title"><a href="/">Green Thumb</a></h1><div class="menu"><ul><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></div></div>
<div id="content" class="site-content"><div class="post"><h2 class="entry-title">Tomatoes in the rain</h2><div class="entry-content"><p>{P[0]}</p><blockquote><p>{P[1]}</p></blockquote><ul><li>Water them early in the day.</li><li>Take the lower leaves off.</li></ul><p>{P[2]}</p></div>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></div><div id="comments" class="comments-area"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>I lost all of mine this year, sadly.</p></li><li class="comment"><p>Thank you, this helped me a lot.</p></li></ol><form id="respond"><label>Name</label><input><button>Post comment</button></form></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h3>Archives</h3><ul><li><a href="/2019">2019</a></li><li><a href="/2020">2020</a></li></ul></div></div><div id="footer">Proudly powered by some software.</div></div></body></html>"""
BLOG_WANT = ["Tomatoes in the rain", P[0], P[1], "Water them early in the day.", "Take the lower leaves off.", P[2]]

DOCS = f"""<!DOCTYPE html><html><body><nav class="navbar"><a href="/">Docs</a><a href="/api">API</a><form class="search"><input placeholder=Search></form></nav><div class="container"><div class="toc sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div>
<main role="main"><section id="a"><h1>Install</h1><p>{P[0]}</p><pre>pack install bridge --all</pre><p>{P[1]}</p></section><section id="b"><h2>Use</h2><p>{P[2]}</p><table><tr><th>Flag</th><th>What it does</th></tr><tr><td>-v</td><td>Says more about each step.</td></tr></table></section></main></div><footer><p>Built with care. <a href="/license">License</a></p></footer></body></html>"""
DOCS_WANT = ["Install", P[0], "pack install bridge --all", P[1], "Use", P[2], "Flag", "What it does", "-v", "Says more about each step."]

NOTICE = f"""<html><body><div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience. By going on you agree.</p><button>Accept all</button></div><div class="wrapper"><div class="breadcrumbs"><a href="/">Home</a> &rsaquo; <a href="/n">Notices</a></div>
<article><header><h1>Notice of works</h1></header><p>{P[3]}<p>{P[2]}<p>{P[1]}</article><div class="newsletter-signup"><h4>Get our newsletter</h4><p>Sign up to have the week in your inbox.</p><form><input type=email><button>Sign up</button></form></div><section class="related"><h3>Related articles</h3><a href="/r1">Road works in May</a><a href="/r2">A new park</a></section></div></body></html>"""
NOTICE_WANT = ["Notice of works", P[3], P[2], P[1]]

PLAIN = f"""<HTML><BODY BGCOLOR=white><DIV CLASS=nav><A HREF=/>home</A> | <A HREF=/b>bridges</A> | <A HREF=/c>contact</A></DIV><DIV ID=content><H1>All about bridges</H1><P>{P[0]}<BR>{P[1]}</P><P>{P[2]} <B>{P[3]}</B></P></DIV><DIV ID=footer>Last changed in 1999. <A HREF="mailto:x@y.z">Write to us</A></DIV></BODY></HTML>"""
PLAIN_WANT = ["All about bridges", f"{P[0]} {P[1]}", f"{P[2]} {P[3]}"]

MAGAZINE = f"""<!DOCTYPE html><html><body><header><div class="ad banner">Shoes at half price, today only!</div><nav><ul><li><a href=/a>Food</a><li><a href=/b>Travel</a></ul></nav></header><main><article><h1>Ten days on foot</h1><div class="article-body"><p>{P[0]}</p><div class="advertisement"><p>Sponsored: a bank that you can trust.</p></div><p>{P[1]}</p><h3>Day two</h3><p>{P[2]}</p><p>{P[3]}</p></div></article><div class="author-bio">By <a href=/j>J. Walker</a></div></main>
<div class="comments"><h4>Comments</h4><div class="comment"><p>What a walk that must have been.</p></div></div><footer>&copy; Magazine</footer><script>var x = "<article><p>not this</p></article>";</script></body></html>"""
MAGAZINE_WANT = ["Ten days on foot", P[0], P[1], "Day two", P[2], P[3]]

EMPTY = """<html><body><nav><a href=/>Home</a><a href=/x>Login</a></nav><form class=login><label>User</label><input><label>Password</label><input><button>Log in</button></form><footer>&copy; 2021 Company. <a href=/p>Privacy</a></footer></body></html>"""

PAGES = [(NEWS, NEWS_WANT), (BLOG, BLOG_WANT), (DOCS, DOCS_WANT), (NOTICE, NOTICE_WANT), (PLAIN, PLAIN_WANT), (MAGAZINE, MAGAZINE_WANT), (EMPTY, [])]
