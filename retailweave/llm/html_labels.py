"""The labelled table that the block classifier is grown on.

A line is one flat block (`+` main text, `-` anything else) or, without a mark, structure only. Pages differ in how much
the markup gives away: elements with a meaning, class names, or nothing but text and links.
"""

from __future__ import annotations

_SEMANTIC = """
 <html><head><title>River level falls</title><style>p { margin: 0 }</style></head><body>
 <header><div class="logo">
-<a href="/">The Valley Post</a>
 </div></header><nav><ul>
-<li><a href="/news">News</a></li>
-<li><a href="/sport">Sport</a></li>
-<li><a href="/about-us">About us</a></li>
 </ul></nav>
-<div class="cookie-notice">We use cookies to make this site work. By reading on you agree to that. <a href="/p">More</a></div>
-<div class="ad">Buy two pairs of boots and get the third one free, this week only, in all our shops.</div>
 <article>
+<h1>River level falls to its lowest in ten years</h1>
+<p>The river fell to its lowest level in ten years on Tuesday, after a summer with hardly any rain in the hills above.</p>
+<p>Nobody was hurt.</p>
+<p>Boats that <a href="/ferry">carry people</a> across the lake had to stop, and farmers were asked to use less water.</p>
 <aside>
-<h4>Read more</h4>
-<p><a href="/a">How the dam was built</a></p>
 </aside>
+<h2>What comes next</h2>
+<p>Rain is due on Friday, the weather service says, but not much of it.</p>
+<ul><li>Wells are to be checked.</li>
+<li>Fountains stay dry until further notice.</li></ul>
+<blockquote>It has never been this dry, not even in the year of the great fire.</blockquote>
 </article>
 <section id="comments">
-<h3>3 comments</h3>
-<p>I live there and it is worse than you write, the whole meadow is brown and the wells are dry since June.</p>
-<p>Same here!</p>
 <form>
-<p>Leave a reply</p>
 </form></section>
 <footer>
-<p>&copy; The Valley Post. All rights reserved, also those of translation into other languages.</p>
 </footer></body></html>
"""

_CLASSED = """
 <body><div class="site-header">
-<div><a href="/">Kitchen Notes</a></div>
-<div class="search">Find a recipe by its name</div>
 </div><div id="sidebar">
-<h3>Popular this week</h3>
-<p><a href="/1">Seven soups for cold days</a></p>
-<p>Sign up and get one letter a month with the best of our recipes, and nothing else, we promise.</p>
 </div><div class="post-content">
+<h1>Bread without kneading</h1>
+<p>Mix flour, water, salt and very little yeast in the evening, cover the bowl and leave it alone until the next day.</p>
+<p>Then fold.</p>
+<p>An oven as hot as it gets and a pot with a lid make the crust; the <a href="/pot">iron pot</a> needs half an hour in it.</p>
-<div class="newsletter-signup">Do you like this recipe? There is a new one every month in our letter, free of charge.</div>
+<p>Leave the bread to cool on a rack before you cut it, hard as it may be to wait for that long.</p>
 </div>
 <div class="share-buttons">
-<p>Share this with your friends</p>
 </div><div class="comment-list"><div class="comment">
-<p>Mine came out flat, but it tasted well, so I will try again with more flour and a smaller pot next week.</p>
 </div></div><div id="footer">
-<div><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></div>
-<div>Made with care in a small kitchen by people who like to cook.</div>
 </div></body>
"""

_BARE = """
 <html><body><table><tr>
-<td><a href="/">Home</a> <a href="/list">List of birds</a> <a href="/mail">Write to us</a></td>
 </tr></table>
+<h1>The swift</h1>
+<p>The swift spends nearly its whole life in the air; it eats, drinks and even sleeps there, and lands only to breed.</p>
+<p>Young birds leave the nest in July and may stay on the wing for two or three years before they first set foot on anything.</p>
+<p>Its call is a high scream, heard on warm evenings over the roofs of old towns all over the continent from May to August.</p>
-<p><a href="/lark">The lark</a> | <a href="/kite">The kite</a> | <a href="/owl">The owl</a></p>
-<p><a href="/top">Back to the top</a></p>
 </body></html>
"""

_BARE_LONG = """
 <div><div>
-<div><a href="/a">Start</a></div>
-<div><a href="/b">Timetable</a></div>
-<div><a href="/c">Fares and tickets</a></div>
 </div><div>
+<div>The night train is back after twenty years. It leaves at nine in the evening and is at the sea by breakfast time.</div>
+<div>Beds are narrow but clean, and the windows can still be opened, which older travellers will like to hear about.</div>
+<div>Dogs ride free.</div>
+<div>Whoever wants to take a <a href="/bike">bicycle</a> along has to book a place for it when the ticket is bought, not later.</div>
 </div><div>
-<div><a href="/d">Other lines</a></div>
-<div><a href="/e">Work with us</a> <a href="/f">Press</a></div>
 </div></div>
"""

_MAIN = """
 <body>
-<div role="banner"><a href="/">City Library</a></div>
-<nav>Open today until eight</nav>
 <main>
+<h1>Opening hours in winter</h1>
+<p>From November on the reading room closes an hour earlier.</p>
+<p>Why?</p>
+<p>Heating the old hall costs a lot, and few people come in the evening when it is dark and cold outside.</p>
+<table><tr><td>Monday to Friday</td>
+<td>9 to 19</td></tr></table>
 <form action="/ask">
-<p>Ask us a question and we answer within two days</p>
 </form>
-<div class="advertisement">Cheap flights to the sun all winter long, from any airport near you, book before it is too late!</div>
+<p>Books can be handed in at any time through the flap beside the door.</p>
-<div class="related-articles"><a href="/x">New books in May</a></div>
 </main>
-<aside>Friends of the library meet on the first Monday of each month at seven, guests are always welcome to join.</aside>
-<footer>City Library, Market Square 1</footer>
 </body>
"""

_BARE_EDGES = """
 <div>
-<div><a href="/">Home</a></div>
-<div>Est. 1921</div>
-<div><a href="/shop">Shop</a> <a href="/cart">Cart</a></div>
 </div>
+<h2>Repairing a wooden chair</h2>
+<div>Take the loose leg out, scrape off the old glue and let the wood dry for a day in a warm room before you go on.</div>
+<div>Patience helps.</div>
+<div>Put new glue on both parts, press them together and hold them with a belt until the glue is hard, overnight at best.</div>
+<div>Sand the spot and oil it, and the <a href="/oil">oil</a> will hide the seam so well that you have to look for it.</div>
 <div>
-<div><a href="/glue">All kinds of glue</a></div>
-<div>Open daily</div>
-<div><a href="/where">Where to find us</a></div>
-<div>Five stars</div>
-<div><a href="/terms">Terms</a> <a href="/data">Data</a></div>
 </div>
"""

_BARE_LIST = """
 <body>
-<p><a href="/one">One</a></p>
-<p>Today</p>
-<p><a href="/two">Two</a></p>
+<h1>Three ways to the summit</h1>
+<p>The first way follows the brook through the wood, is shady and easy to find, and takes four hours in good weather.</p>
+<p>The second way is steep.</p>
+<p>The third one, over the ridge, is for people who do not mind heights; a rope is a good idea when the rock is wet.</p>
+<p>Whichever you take, start early, carry water and be back in the valley before the afternoon storms come up.</p>
-<p><a href="/map">Map of the valley</a></p>
-<p>Page 3</p>
-<p><a href="/next">Next page</a></p>
 </body>
"""

_LINK_LISTS = """
 <div>
-<div><a href="/1">Spring tours by bus and by boat</a> <a href="/2">Summer tours on foot</a> <a href="/3">Autumn tours to the vineyards</a> <a href="/4">Winter tours with skis and sledges</a> and more</div>
 </div>
+<h1>A week on the canal</h1>
+<p>We took the boat over on Saturday, were shown how the locks work, and were on our own from then on, with a map and a kettle.</p>
+<p>On the second day it rained so hard that we stayed where we were, in front of an inn, and played cards with the crew of another boat.</p>
-<p>More of this: <a href="/5">Ten days on the lakes in a sailing boat without a motor</a>, <a href="/6">A month on the road with a horse and cart</a> and <a href="/7">By train around the whole country</a></p>
+<p>The rest of the week was dry, and <a href="/8">the long tunnel</a>, which we had been warned of, turned out to be the best part of it.</p>
-<p><a href="/9">All tours of this year with dates and prices for groups of four people or more</a> <a href="/10">Terms of travel for groups and for single guests</a></p>
"""

_TEXTS = (_SEMANTIC, _CLASSED, _BARE, _BARE_LONG, _BARE_EDGES, _BARE_LIST, _LINK_LISTS, _MAIN)


def labelled_pages() -> list[tuple[str, list[bool]]]:
    """(page, whether each of its blocks is main text)."""
    out = []
    for text in _TEXTS:
        lines = text.strip("\n").split("\n")
        out.append(("".join(line[1:] for line in lines), [line[0] == "+" for line in lines if line[0] in "+-"]))
    return out
