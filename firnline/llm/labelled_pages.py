"""The small labelled table that the block classifier is trained on: hand-written pages, main text marked with «».

Some have neither names nor tags that tell where the main text is.
"""

LABELLED = (
    """<html><head><title>River floods town</title><style>p{margin:0}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>
<div class="ad">Cheap tyres, today only, call us.</div>
<article><h1>«River floods town»</h1><p>«The river rose by two metres on Sunday night and left half of the lower town under water.»</p>
<p>«Nobody was hurt.»</p><p>«Yes.»</p><p>«According to the <a href="/mayor">mayor</a> the bridge will stay closed until the end of the week, perhaps longer.»</p></article>
<footer>&copy; Town Gazette &middot; all rights reserved.</footer></body></html>""",
    """<body><header><a href="/">The Baker's Blog</a><p>Bread, cakes and more from a small kitchen.</p></header>
<div id="content"><h1>«Sourdough in a day»</h1><p>«A starter that doubles within four hours is all you need.»</p><p>«Mix flour, water and salt.»</p>
<h2>«Baking»</h2><p>«Heat the oven with the pot in it for at least half an hour, then bake for forty minutes without opening the door.»</p>
<ul><li>«500 g flour»</li><li>«350 g water»</li><li>«10 g salt»</li></ul></div>
<aside><h3>About me</h3><p>I bake every weekend and write about what went well and what did not, which is most of it.</p></aside>
<div id="comments"><h3>2 comments</h3><p>Anna: I tried this and the crust came out wonderful, thank you so much for the clear steps!</p><p>Ben: Same here.</p>
<form><label>Your comment</label><input name="c"></form></div><footer><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></footer></body>""",
    """<body><div class="cookie-notice">We use cookies to improve your experience on this site. By continuing you agree to our use of cookies. <a href="#">OK</a></div>
<div class="topmenu menu"><a href="a">Products</a> | <a href="b">Support</a> | <a href="c">Contact</a></div>
<main><h2>«Printer does not wake up»</h2><p>«If the printer stays asleep after a firmware update, unplug it for a minute.»</p><p>«Then hold the power button until the light blinks twice; the counter is reset by that and the next job wakes the printer as before.»</p></main>
<div class="related"><h3>Related articles</h3><a href="1">Paper jams in tray two</a><br><a href="2">Replacing the drum</a></div></body>""",
    """<table><tr><td><a href="/1">Index</a></td><td><a href="/2">Archive</a></td></tr></table>
<p>«In the spring of that year the expedition reached the northern coast, and for the first time the whole company could rest for more than a single night.»</p>
<p>«The stores had held out better than anyone had dared to hope, though the flour was wet and the last of the dogs had gone.»</p>
<p>«From here on the party followed the shore, sleeping under the boat, until the first huts came into sight some eleven days later.»</p>
<p><a href="/prev">Previous</a> <a href="/next">Next</a></p><p>Last changed in May</p>""",
    """<div>Home News Weather</div><div><a href="/x">Sign in</a></div>
<div>«The council voted eight to three on Thursday to extend the tram line to the harbour, ending a debate that had lasted for almost a decade in the city.»</div>
<div>«Work is to begin next summer and to take about four years, with the first trains running to the market hall after two, the planners told reporters after the vote.»</div>
<div>Share this</div><div>Follow us on all channels</div><div><a href="/t">Terms</a></div>""",
    """<body><div role="banner">City Library</div><div role="navigation"><a href="/">Start</a><a href="/hours">Hours</a></div>
<div role="main"><h1>«Reading room closed»</h1><p>«The reading room is closed on Friday.»</p><p>«Books can be returned at the desk on the ground floor as usual until six in the evening.»</p></div>
<div role="complementary"><p>Subscribe to our newsletter and get all events of the month in one letter, free of charge and without advertising.</p></div>
<div role="contentinfo">City Library, Long Street 5</div></body>""",
    """<article class="post"><header><h1>«Ten years of garden notes»</h1></header><div class="entry"><p>«Ten.»</p><p>«It began with a broken thermometer.»</p>
<blockquote>«Write down the frost, my neighbour said, you will forget it by May.»</blockquote><p>«I did, and so there are ten winters here, with gaps.»</p></div>
<div class="share"><a href="f">Share</a><a href="t">Send</a></div><div class="sponsor">This page is supported by Miller's Seeds, order the new catalogue with all our vegetables and flowers now.</div>
<section class="comments"><p>What a lovely collection, I have kept similar notes since we moved here and would never want to miss them.</p></section></article>""",
    """<nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/d">Docs</a> &gt; Install</nav><div class="sidebar"><ul><li><a href="1">Install</a></li><li><a href="2">Configure</a></li><li>New in this version: faster start, smaller files and a new way to write plugins</li></ul></div>
<div class="content"><h1>«Install»</h1><p>«Unpack the archive.»</p><pre>«tar xf tool.tar»</pre><p>«Run it once.»</p><p>«The tool writes a file with its settings to your home folder, where you can change them with any editor.»</p></div>
<div class="footer">Documentation licensed freely. Built with care by many people over many years, see the list of authors.</div>""",
    """<p>Menu</p><p><a href="/a">Shop</a></p><p><a href="/b">Cart</a></p><p>«Our wool comes from four farms in the hills, all within an hour of the mill, and every skein carries the name of the farm and the month of the shearing.»</p>
<p>«We spin slowly and in small lots; the colours of two lots are never quite the same, so please order enough for the whole piece at once.»</p><p>Call us</p><p><a href="/m">Map</a></p>""",
    """<div class="advert">Win a trip to the sea! Answer three simple questions about our new soap and you could be on the beach by Friday.</div>
<article><h2>«Match report»</h2><p>«Two nil.»</p><p>«After a dull first half the home side came out with three strikers and scored twice within five minutes.»</p><p>«Rain.»</p>
<p>«Read the <a href="p">preview</a>.»</p></article><form><p>Tell us your opinion in the form below, we read every single message that arrives and answer most.</p></form>
<div class="newsletter">Get the results by mail every Sunday evening</div>""",
    """<div class="page"><div class="masthead">Daily Letter</div><div class="story"><h1>«Bees return»</h1><p>«Bees are back in the old orchard.»</p><p>«The hives were set up in March.»</p><p>«Honey is expected in July, if the weather holds and the lime trees flower well this year.»</p></div>
<div class="legal">No part of this paper may be copied without leave of the publisher, whose address is given on the last page.</div></div>""",
    """<div><p>«When the mill closed the village lost its school, its shop and, within a generation, most of its people, and what is left today are nine houses and a chapel.»</p></div><div><p>«A few of the families come back in summer to mend the roofs.»</p></div>
<div><p>«They hope that the new road will change things, though nobody seems to know when it will be built or who is going to pay for the tunnel.»</p></div><div>Tags: <a href="v">village</a> <a href="m">mill</a></div><div>Print</div>""",
    """<p><a href="/">Start</a> <a href="/all">All letters</a></p>
<p>«The harbour froze in the second week of January, and for a month the mail came over the ice on a sledge drawn by two small horses.»</p>
<p>«Nobody had seen that before.»</p>
<p>«The postmaster kept a stove in the boat house for the drivers, who told him every evening which places were safe and which were not any longer.»</p>
<p>«He wrote it all down.»</p><p>«So we know today where the ice was thick, how long the crossing took and what the drivers were paid for it in that winter.»</p>
<p>Printed by the harbour museum</p>""",
    """<div><a href="/a">Maps of the region</a></div><div><a href="/b">Timetables and fares for all lines</a></div><div><a href="/c">Lost property office</a></div>
<div><a href="/d">Rules for the carriage of bicycles, dogs and large luggage on all our buses and trams during the week and on Sundays</a></div><div>Contact</div>
<div><a href="/e">Complaints and suggestions can be sent to this office on working days between nine and four, by letter or in person</a></div>""",
    """<article><h1>«<a href="/p/1">How we moved the clock</a>»</h1><p>«The clock of the old station weighs as much as a small car.»</p><p>«It took six of us.»</p>
<p>«We lifted it with the crane of the boat yard, which came at night because the road had to be closed for it.»</p>
<ul><li><a href="/p/2">The clock that stood still for twenty years</a></li><li><a href="/p/3">Who owns the old station today, and why</a></li></ul></article>""",
    """<main><h1>«Opening hours»</h1><p>«The pool is open daily from seven.»</p><p>«Closed on holidays.»</p><p><a href="/prices">Prices</a> <a href="/courses">Courses</a> <a href="/way">How to get here</a></p>
<p>«Children under six swim free of charge, if an adult who can swim is in the water with them at all times.»</p><p><a href="/more">Read the complete rules of the house</a></p></main>""",
    """<article class="featured related"><h2>«A second life for sails»</h2><p>«Old sails make good bags.»</p><p>«The loft by the canal cuts and sews them, and sells what it makes on the market every second Saturday of the month.»</p></article>
<div class="related"><p>You may also like what our readers bought along with this bag in the last weeks, ask for it in the shop.</p></div>""",
    """<article><h1>«Slow trains»</h1><p>«There is a line in the hills that nobody takes to arrive.»</p><p>«It climbs for two hours, stops at places that have lost their names and turns where the rails end at a wall of rock and fern.»</p>
<section class="comments"><article class="comment"><p>I took it with my father when I was nine, and we had to push the carriage for the last part of the way.</p></article></section></article>""",
    """<table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td><td><a href="/3">Three</a></td></tr></table>
<h1>«On keeping bees in towns»</h1><p>«Bees find more to eat in a town than most people think, since something is in flower on some balcony or railway bank from March to October.»</p>
<h2>«Water»</h2><p>«Put out a dish.»</p><p>«Stones in it keep the bees from drowning, and the water has to be changed before it turns green, which takes about a week in summer.»</p>
<p><a href="/4">Next: hives</a></p><p>Imprint</p><p>Write to us</p>""",
    """<div>Welcome</div><div><a href="/x1">News</a> <a href="/x2">Jobs</a> <a href="/x3">Press</a></div>
<div>«The new hall has room for six hundred people and was paid for by the town, the county and a great number of small gifts.»</div>
<div>«It opens in May.»</div><div>«Choirs can rent it at half the price on weekdays, and schools need to pay for heating and light only, as the mayor pointed out.»</div>
<div><a href="/x4">Plan of seats</a></div><div><a href="/x5">Tickets</a></div><div>Top</div>""",
    """<nav><a href="/">Plays</a><a href="/b">Books</a></nav><article><h1>«The ferry»</h1>
<p>«The ferryman sat on the step of his hut and watched the two of them come down the path, slowly, with the box between them, as if it were made of glass.»</p>
<p>«Good evening.»</p><p>«He nodded and looked at the box for some time, then at the river, which had come up since noon and carried branches and foam.»</p>
<p>«Heavy?»</p><p>«Very.»</p><p>«They set it down on the planks, and the younger one wiped his hands on his coat and asked what it would cost to cross before dark.»</p>
<p>«Nothing.»</p><p>«Nothing?»</p><p>«The ferryman laughed, got up and loosened the rope, and said that on the day of the flood he never took money from anybody with a box.»</p>
<p>«Why?»</p><p>«Nobody answered.»</p><p>«Half way over the current took hold of them, and for a moment the hut, the willow and the light in the window slid away sideways.»</p><p>«Hold on!»</p></article>
<footer>Printed in the old town, all rights with the author</footer>""",
    """<main><h1>«Notes»</h1><p>«Monday»</p><p>«Rain all day, the cellar is dry so far, but the gutter over the door has to be cleaned before the next storm comes in from the west.»</p>
<p>«Tuesday»</p><p>«Cleaned it.»</p><p>«Two nests.»</p><p>«The stairs are finished, forty one steps with the one at the top that nobody counts, and the rail will be fixed as soon as the oak is here.»</p>
<p>«Wednesday»</p><p>«No oak.»</p></main><div class="footer"><p>Written by hand</p><p>Top</p></div>""",
    """<nav><a href="/">Home</a></nav><article><p>«Dear all,»</p><p>«The meeting on Friday is put off by a week, since the hall is needed for the blood donors and the school has no room for us.»</p>
<p>«Yours, Ada»</p></article><nav><a href="/1">Older</a></nav><article><p>«Thanks!»</p><p>«See you there.»</p></article><nav><a href="/2">Newer letters</a></nav>""",
    """<div role="navigation"><a href="/">Menu</a> <a href="/s">Search</a></div><main><p>«Sold out.»</p></main><footer><a href="/i">Imprint</a></footer>""",
    """<header><a href="/">Start</a></header><div class="content"><p>«No change.»</p><p>«All trains run to time.»</p></div><div class="sidebar"><a href="/t">Tickets</a></div><footer><a href="/i">Imprint</a></footer>""",
)
