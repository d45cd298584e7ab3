"""Pages labelled by hand: what carries the attribute c is main text, all other text is not."""

PAGES = [
    # a blog without semantic elements; short lines and a list amid the text, an advert without a name
    """<body><div id="top"><a href="/">My garden</a> <a href="/about">About</a></div><div id="page"><h1 c>Tomatoes</h1>
    <p c>This year I sowed the tomatoes in the first week of March, on the window sill of the kitchen.</p><p c>Why?</p><p c>They need light.</p>
    <ul><li c>seed</li><li c>soil</li><li c>pots</li></ul><p c>After two weeks the first leaves are there, and the pots can go outside on warm days.</p>
    <p c>So.</p><div class="promo">Buy seeds now, all of them half the price until the end of the month.</div><p c>I water them every evening, but never over the leaves.</p></div>
    <div class="sidebar"><h3>Recent posts</h3><ul><li><a href="1">Roses in winter</a></li><li><a href="2">A new spade</a></li></ul></div><div id="footer">Copyright 2021 by me</div></body>""",
    # a story with dialogue
    """<body><div class="menu"><ul><li><a href="a">Home</a><li><a href="b">Books</a></ul></div><div class="chapter"><h2 c>Chapter 3</h2>
    <div c>The door opened slowly and the old man looked out into the rain with his lamp.</div><div c>No</div><div c>Yes</div><div c>Who</div>
    <div c>He did not answer for a long time, and then he closed the door without a word.</div><div c>Silence</div><div c>On the next morning the lamp still stood on the wall beside the gate.</div></div>
    <div class="pager"><a href="2">Back</a> <a href="4">On</a></div><div class="legal">All rights reserved by the author and the house that printed it.</div></body>""",
    # a recipe, its ingredients in a table
    """<body><header><a href="/">Kitchen</a><p>The best recipes of the whole web, for each and every day.</p></header><div class="recipe"><h1 c>Bread</h1>
    <p c>A plain bread that takes a day, of which you work ten minutes at most.</p><table><tr><td c>flour</td><td c>500 g</td></tr><tr><td c>water</td><td c>350 g</td></tr><tr><td c>salt</td><td c>10 g</td></tr></table>
    <p c>Mix it all and leave it to stand over night in a bowl under a cloth.</p><p c>Fold</p><p c>Bake it for an hour in a pot with a lid, and let it cool before you cut it.</p></div>
    <div class="comments"><h3>Comments</h3><p>I made it twice already and my family likes it a lot, thank you.</p><p>Too much salt for me, but otherwise it is a very good bread.</p></div>
    <form><p>Leave your name and say what you think about this bread.</p><input></form></body>""",
    # news, with links within the text and a box of related stories
    """<body><nav><a href="1">World</a><a href="2">Sport</a></nav><div class="story"><h1 c>River rises again</h1><p c>The <a href="r">river</a> rose by two metres over night, the town said on Monday.</p>
    <p c>Schools stay closed</p><p c>Helpers filled sand bags along the old quay, where water stood in the cellars by noon.</p>
    <div class="related"><h4>Read more</h4><ul><li><a href="3">Last year's flood and what was learned</a></li><li><a href="4">How dams are built</a></li></ul></div>
    <p c>Rain</p><p c>More rain is expected until Thursday, and then the wind should turn to the north.</p></div><div class="cookie-bar">We and our partners use cookies on this site. Accept all or change the settings.</div>
    <footer><p>&copy; The Paper. Write to us at any time, we are glad to hear from you.</p></footer></body>""",
    # documentation: headings, terms and code
    """<body><div role="navigation"><ul><li><a href="i">Install</a></li><li><a href="u">Use</a></li></ul></div><div><h1 c>split</h1><p c>Cuts a text at each place where the sign stands.</p>
    <h2 c>Parameters</h2><dl><dt c>text</dt><dd c>what is cut</dd><dt c>sign</dt><dd c>one character</dd></dl><h2 c>Returns</h2><p c>A list of the parts, at least one, in the order in which they stand in the text.</p>
    <pre c>split("a,b", ",")</pre></div><div class="footer"><p>Made with care by many hands, since the year 2009.</p></div></body>""",
    # old layout by tables
    """<table><tr><td><a href="1">Start</a><br><a href="2">Pictures</a><br><a href="3">Guest book</a></td><td><h2 c>Our trip to the sea</h2><p c>We left at five in the morning, when it was still dark and cold.</p>
    <p c>Then: the sea</p><p c>At noon we sat on the beach, and the children ran into the water at once.</p><p c>Cold!</p></td></tr></table><div class="copyright">&copy; 2003 family Miller, all pictures are our own</div>""",
]
