"""Problem 9: score documents for abuse and threats, hate and sexually explicit language.

Method: a weighted lexicon is matched by an Aho-Corasick automaton over folded text.  Folding undoes what a writer may do
to hide a word: invisible characters, look-alike letters, digits and signs for letters (`4n1m4ls`), letters set apart
(`v e r m i n`, `b.a.c.k`) and stretched letters (`wannnt`).  Exception phrases cancel the terms they cover or stand near
(`breast cancer`, `idiot-proof`).

The lexicon names classes of words by what they mean (insults, ways to hurt, parts of the body, dehumanising nouns, words of
expulsion, vulgar organs, ...) in English, German, French and Spanish.  Some classes weigh by themselves; `RULES` combine
classes that stand near each other: an insult said to somebody, an announced act of violence against somebody, a
dehumanising noun predicated of people, a sexual act with the reader.  Names of peoples are a class of their own (`groups`,
a parameter), with general ones as the default.

The score is normalised by length: the largest weight for each `WINDOW` words over all stretches of text, where a stretch
shorter than `WINDOW` words counts as that long.  So one abusive sentence in a long mail weighs as much as in a short one,
and mild terms spread over a mail weigh little.  `per_1000` gives the same quotient for the whole document.  A document is
flagged from `THRESHOLD` on.

Lexicon, rules, exceptions and groups are the only data sent to the tasks, and their size does not depend on the documents.
Each document is scored alone, in one pass without a shuffle; null and empty texts score 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .lookalikes import to_latin
from .mime import visible

THRESHOLD = 1.0
WINDOW = 24
NEAR = 12

# Classes of terms, "class kind weight: terms".  Terms of weight 0 count in rules only.  ~ stands for the endings
# "", e, s, es, er, en, em, n and ^ for o, a, os, as.  Classes named below "near" are single words that are looked up
# beside the others only.
LEXICON = """
INSULT abuse 0.6: idiot~, moron~, imbecile~, cretin~, scumbag~, bastard~, bitch~, retard~, dumbass, dumbasses, jackass, wanker~, twat~,
  prick~, douchebag~, lowlife~, fuckwit~, halfwit~, dimwit~, nitwit~, shithead~, dipshit~, asswipe, tosser~, bellend~, knobhead~,
  whore~, slut~, skank~, loser~, coward~, liar~, scum, degenerate~, pervert~, dirtbag~, sleazebag~, buffoon~, ignoramus, simpleton~,
  trottel~, depp~, penner~, pisser~, spasti~, schwachkopf, schwachköpfe, dummkopf, idiotin, blödmann, volltrottel~,
  vollidiot~, vollpfosten, lügner~, versager~, abschaum, dreckskerl~, drecksack, mistkerl~, miststück, nutte~, luder, gesindel,
  crétin~, imbécile~, abruti~, débile~, bâtard~, ordure~, salaud~, salopard~, conne~, pauvre con, sale con, gros con, petit con, espèce de con, bande de cons,
  pute~, pouffiasse~, raclure~, minable~, bouffon~, crapule~, tocard~, bon à rien, bonne à rien,
  imbécil~, idiota~, estúpid^, pendej^, putita~, puta, putas, zorra~, guarr^, escoria, payas^, cretin^, subnormal~, mongol^, sinvergüenza~, desgraciad^, canalla~, inútil~, capull^
BEAST abuse 0.2: cow, cows, pig, pigs, swine, dog, dogs, snake, weasel, rat, cockroach, maggot~, vermin, parasite~, filth, creep~, clown~, fool~, psycho~, tool, dolt~, freak~,
  schwein~, sau, kuh, hund~, affe~, ratte, porc, porcs, truie~, vache, chien~, ordure~, cerd^, rata, ratas, perr^, gusan^, burr^, basura
VULGAR abuse 1.0: asshole~, arsehole~, dickhead~, motherfucker~, motherfucking, cocksucker~, son of a bitch, sons of bitches, cunt~,
  arschloch, arschlöcher, wichser~, hurensohn, hurensöhne, fotze~, missgeburt~, drecksau, schlampe~, arschficker, connard~, connasse~,
  enculé~, fils de pute, salope~, enfoiré~, gilipollas, cabrón, cabrona, cabrones, hijo de puta, hija de puta, hijos de puta, malparid^, mamón, maricón,
  hijueputa
DEMEAN abuse 0.2: worthless, useless, pathetic, disgusting, miserable, braindead, stupid, dumb, brainless, filthy, dirty, ugly, lying, lazy, fat,
  fucking, sick, spineless, clueless, incompetent, despicable, repulsive, vile, wretched, goddamn, stinking, rotten, nasty, retarded,
  elend~, wertlos~, dumm~, blöd~, dreckig~, hässlich~, fett~, faul~, verlogen~, widerlich~, erbärmlich~, dämlich~, scheiss, verdammt~, mies~,
  pauvre, sale~, stupide~, minable~, dégueulasse~, immonde~, crasseux, crasseuse~, gros, grosse~, petite, petit, inutile~, répugnant~, moche~, laid~,
  asqueros^, inútil~, estúpid^, miserable~, maldit^, suci^, feo, fea, gord^, repugnante~, put^, jodid^, pedazo de, patétic^
CURSE abuse 1.0: fuck you, fuck off, fuck yourself, fuck ur, screw you, go to hell, rot in hell, burn in hell, die in a fire, eat shit, kiss my ass,
  drop dead, kill yourself, hang yourself, drown yourself, shoot yourself, jump off a bridge, jump off a cliff, jump in front of, slit your wrists, waste of skin, waste of oxygen, waste of air,
  better off dead, better off without you, nobody would miss you, no one would miss you, nobody will miss you, go kill, crawl back, crawl under,
  verpiss dich, verpisst euch, fick dich, fickt euch, leck mich, halt die fresse, halts maul, halt dein maul, halt dein dreckiges maul, halt deine fresse, maul halten,
  fahr zur hölle, geh sterben, häng dich auf, bring dich um, erschiess dich, verreck, verrecke, verzieh dich, zieh leine, kratz ab,
  ta gueule, ferme la, va te faire foutre, va te faire enculer, va crever, allez crever, nique ta mère, va mourir, va te pendre, va te tuer, va en enfer, va au diable, crève, tue toi, pends toi, casse toi,
  vete a la mierda, vete al infierno, vete al carajo, vete a tomar por culo, que te jodan, que te den, jódete, muérete, mátate, púdrete, ojalá te mueras,
  tírate por, cuélgate, chinga tu madre, cierra la boca, cierra el pico, me cago en tu
HUSH abuse 0.4: shut up, shut your mouth, shut your face, halt die klappe, halt den mund, tais toi, la ferme, cállate, a callar
PIECE abuse 0.5: piece of shit, pile of shit, bag of shit, sack of shit, piece of garbage, piece of crap, sack of crap, piece of trash, piece of filth, human garbage,
  waste of space, stück scheisse, haufen scheisse, stück dreck, morceau de merde, tas de merde, sac à merde, pedazo de mierda, pedazo de basura
NOTHING abuse 0.2: shit, crap, garbage, trash, scheisse, dreck, merde, déchet, mierda, porquería, nothing but
WISH none 0.0: hope, hopes, wish, pray, deserve, deserves, hoffe, hoffentlich, verdienst, espère, souhaite, mérites, ojalá, espero, mereces
DIE none 0.0: die, dies, died, rot, choke, suffocate, burn, suffer, drown, bleed, cancer, perish, dead, sterben, verrecken, crever, mourir, morir
DIEYOU none 0.0: stirbst, krepierst, verreckst, erstickst, leidest, crèves, meures, mueras, te pudras, te ahogues, sufras, revientes
KILL none 0.0: kill, murder, strangle, stab, shoot, slaughter, butcher, behead, lynch, rape, skin, gut, maim, cripple, massacre, execute, castrate,
  umbringen, töten, abstechen, erschiessen, erwürgen, ermorden, abschlachten, vergewaltigen, totschlagen, tot schlagen,
  tuer, égorger, buter, crever, étrangler, massacrer, violer, assassiner, poignarder, matar, degollar, asesinar, rajar, violar, estrangular, apuñalar, liquidar
KILLED none 0.0: killed, murdered, shot, gassed, exterminated, locked up, hanged, hung, lynched, burned, burnt, executed, slaughtered, put down, wiped out, deported, eradicated, castrated, sterilized, beheaded,
  vergast, erschossen, aufgehängt, ausgerottet, abgeschoben, getötet, verbrannt, rausgeworfen, rausgeschmissen, ausgewiesen, beseitigt, weggesperrt, eingesperrt,
  tués, exterminés, gazés, pendus, brûlés, expulsés, éliminés, fusillés, exterminados, gaseados, expulsados, fusilados, ahorcados, quemados, eliminados, deportados
HURT none 0.0: break, smash, cut, slit, beat, burn, crush, hurt, bash, punch, kick, rip, tear, slice, snap, hit, shatter, kneecap, einschlagen, brechen, polieren, zusammenschlagen, verprügeln, schlag,
  schlage, brech, breche, polier, poliere, hau, haue, casser, péter, briser, défoncer, fracasser, couper, romper, partir, reventar, quebrar, cortar, machacar
SLAY none 0.0: bring, bringe, mach, mache, bringt
AWAY none 0.0: um, fertig, kalt
BODY none 0.0: leg, legs, neck, bones, face, skull, throat, head, teeth, fingers, knees, knee, kneecaps, arms, arm, nose, jaw, ribs, spine, balls, eyes, mouth, hals, beine, bein, genick, knochen, schädel,
  zähne, finger, kopf, nase, fresse, kiefer, gesicht, rippen, jambes, jambe, dents, gueule, cou, bras, crâne, nez, tête, figure, os, doigts, genoux, piernas, pierna, cara, dientes, cuello, huesos,
  cabeza, brazos, nariz, boca, rodillas, dedos, alma
INBODY none 0.0: bone in your body, bone in your, bones in your
KIN none 0.0: family, children, kids, kid, wife, husband, mother, daughter, son, parents, house, home, familie, kinder, frau, mann, mutter, tochter, haus, famille, enfants, femme, mari, mère, fille,
  maison, familia, hijos, esposa, madre, hija, casa
VIOLENT abuse 1.0: bullet in your head, bullet in your skull, beat you up, beat you to death, beat you to a pulp, beat the shit out of you, kick your ass, make you pay for, make you suffer,
  knock your teeth, you are a dead man, you re dead, you are dead meat, watch your back, sleep with one eye open, slit your throat, cut your throat, break your legs, break your neck, break your bones, smash your face, smash your head,
  burn your house down, burn down your house, bash your head, bash your face, rip your head off, mach dich kalt, mache dich kalt, mach dich fertig, mache dich fertig, schlag dich tot, schlage dich tot, bring dich um, bringe dich um, bist tot,
  te faire la peau, te casser la gueule, te casser la figure, t es mort, tu es mort, te péter la gueule, te voy a matar, voy a matarte, te vamos a matar, te mataré, te voy a romper, romperte la cara, partirte la cara, estás muert^
STALK abuse 0.6: know where you live, know where you work, know where you sleep, know where your, know which school, weiss wo du wohnst, wissen wo du wohnst, sais où tu habites,
  sais où tu vis, savons où tu habites, sé dónde vives, sabemos dónde vives, watching you, you will regret this, you will pay for this, you ll pay for this, wirst du bereuen, tu vas le regretter, te vas a arrepentir, lo vas a pagar
DEHUMAN hate 0.2: vermin, rats, cockroaches, parasites, animals, apes, monkeys, pigs, dogs, lice, maggots, plague, disease, savages, scum, filth, trash, garbage, leeches, locusts, cattle, cows, infestation,
  ungeziefer, ratten, schmarotzer, parasiten, abschaum, tiere, affen, schweine, dreck, müll, gesindel, pest, bestien, kakerlaken, schädlinge, viecher,
  vermine, rats, parasites, animaux, cafards, singes, porcs, racaille, chiens, ordures, bêtes, sauvages, sangsues,
  ratas, cucarachas, animales, monos, cerdos, perros, escoria, basura, plaga, parásitos, chusma, bestias, salvajes, sanguijuelas
SUBHUMAN hate 1.0: subhuman, subhumans, untermensch, untermenschen, sous hommes, sous homme, infrahumanos, master race, race traitor, sale race, raza inferior, minderwertige rasse, race inférieure,
  nigger~, kike~, faggot~, raghead~, wetback~, chink~, sand monkey, towelhead~, kanake~, kanacke~, judensau, bougnoule~, bicot~, youpin~, sale arabe, sale juif, sale noir, sudaca~, negrata~, negro de mierda, moro de mierda,
  ethnic cleansing now, heil hitler, white power, sieg heil, gas the, belong in the kitchen, belongs in the kitchen, gehören in die küche, gehört in die küche, gehören an den herd, à la cuisine les femmes, a la cocina
CRIME none 0.0: thieves, criminals, rapists, murderers, liars, cheats, cheaters, terrorists, diebe, verbrecher, kriminelle, vergewaltiger, mörder, lügner, betrüger, voleurs, criminels, violeurs, assassins, menteurs,
  tricheurs, ladrones, criminales, violadores, asesinos, mentirosos, delincuentes
NOBRAIN none 0.0: no brain, no brains, no soul, less than human, too stupid, too dumb, too weak, kein hirn, keinen verstand, zu dumm, pas de cerveau, trop bêtes, no tienen cerebro, sin cerebro
INFERIOR none 0.0: inferior, mentally ill, subnormal, insane, krank, pervers, malades, enferm^, disgusting, stupid, filthy, dirty, evil, unclean, minderwertig, dreckig, dumm, inférieurs, inférieures, sales, stupides, inferiores, suci^, estúpid^, asqueros^
FOUL none 0.0: filthy, dirty, stinking, lying, thieving, fucking, goddamn, damned, disgusting, dreckige, dreckigen, verdammte, verdammten, stinkende, sales, sale, maldit^, suci^, put^, asqueros^
BREED hate 0.6: breed like, breeding like, multiply like, multiplying like, vermehren sich wie, se reproduisent comme, se multiplient comme, se reproducen como, se multiplican como
NATURE hate 0.4: by blood, by birth, by nature, in their blood, in their genes, in their nature, von natur aus, im blut, par nature, dans le sang, de nature, por naturaleza, en la sangre, de nacimiento
EXPEL hate 0.6: thrown out of, throw them out, kick them out, kick them all out, kicked out of the country, throw them all out, drive them out, get rid of them, send them back, send them home, send them all, ship them back, deport them, go back to your country, back where they came from, back to where they came from, out of our country,
  gehören rausgeworfen, gehören abgeschoben, raus mit ihnen, raus mit denen, weg mit denen, weg mit ihnen, ausländer raus, schmeisst sie raus, werft sie raus, abschieben alle, alle abschieben, haut ab,
  qu on les chasse, chassez les, foutez les dehors, mettez les dehors, virez les, retournez dans votre pays, rentrez chez vous, retourne dans ton pays, dehors les,
  hay que echarlos, hay que expulsarlos, que se vayan, échenlos, fuera de aquí, fuera de nuestro país, no los queremos, vuelve a tu país, a su país
ERASE hate 0.8: wipe them out, exterminate them, kill them all, gas them, gas them all, burn them all, shoot them all, eradicate them, put them down, put them all down, round them up, hang them all, vergast sie, rottet sie aus, bringt sie alle um, ausrotten, ausmerzen,
  exterminez les, tuez les tous, éliminez les, brûlez les, exterminarlos, matarlos a todos, acabar con ellos, hay que matarlos, al paredón, in die gaskammer, ins gas
UNWANTED hate 0.3: we do not want, we don t want, not welcome here, never trust, wollen wir hier nicht, wollen wir nicht, traue nie, on ne veut pas de, nous ne voulons pas de, no queremos, nunca confíes
SCORN hate 0.4: they stink, they steal, they smell, they lie and, sie stinken, sie stehlen, sie klauen, ils puent, ils volent, apestan, huelen mal, roban todo
SEND none 0.0: send, ship, kick, throw, put, schickt, renvoyez, mandad, devolved
BACKTO none 0.0: back in, back to where, back to their, back where, back home, dorthin zurück, chez eux, a su tierra
WHOLE hate 0.3: whole lot of them, all of them, every one of them, every last one, the lot of them, typical, alle gleich, alle zusammen, samt und sonders, tous sans exception, tous les mêmes, toutes les mêmes, todos iguales, sin excepción, todos ellos
BITE sexual 0.7: ma bite, ta bite, sa bite, grosse bite, grosses bites
ORGAN sexual 0.4: pussy, pussies, cock, cocks, dick, dicks, tits, titties, boobs, cunt, clit, penis, dildo~, nipples, asshole, butthole, muschi~, möse~, schwanz, titten, fotze, möpse, schwänze, chatte~, seins, nichons, couilles, cul,
  coño~, polla~, tetas, verga~, pezones, culo, chocho
AROUSED none 0.0: wet, hard, horny, naked, nude, big, huge, hot, hung, juicy, tight, throbbing, busty, geil~, nackt~, feucht~, nass~, gross~, nue, nues, nu, mouillée, dure, chaude~, gros, desnud^, mojad^, caliente~, dur^, grandes
HOT sexual 0.3: horny, xxx, uncensored, hardcore, sexy, erotic, naked, strip, stripping, masturbation, orgasm~, geil~, nackt~, à poil, desnud^, sex cam, webcam, on camera, vor der kamera, devant la caméra, en cámara, ante la cámara, bend over, spread your legs
PORN sexual 0.6: porn, porno~, pornography, porn videos, sex videos, sex tape, xxx videos, free xxx, pornovideos, vidéos porno, videos porno
FUCK sexual 0.4: ficken, bumsen, enculer, follar, follarme, masturbation
SEXACT none 0.0: fuck, fucking, suck, sucks, sucking, lick, licking, ride, bang, screw, eat, cum, jerk, stroke, ficken, ficke, fick, lutschen, lutsch, lecken, blasen, bumsen, vögeln, poppen, baiser, sucer, suce, lécher, lèche, niquer, enculer, branler,
  follar, follarte, follarme, chupes, chupar, chuparte, chupa, chupame, lamer, lamerte, coger, cogerte, montar, mamar
EXPLICIT sexual 1.0: blowjob~, handjob~, gangbang~, cumshot~, bukkake, deepthroat~, masturbate~, masturbating, milf~, anal sex, oral sex with, creampie, fuck me, make you cum, until you cum, till you cum, cum in your, cum on your, cum all over, came all over her, came all over his, came all over your, ride my cock, take you from behind,
  nude pics, naked pics, nudes, nude pictures of you, dick pics, dick pic, nacktbilder, nacktfotos von dir, will dich ficken, ich will ficken, wichsen, wichse auf, abspritzen, photos de toi nue, toi à poil, te baiser, te sucer, te lécher, te prendre par derrière, éjaculer,
  fotos desnuda, fotos tuyas desnuda, quiero follar, follarte, quiero cogerte, chuparte la, chuparte el, lamerte el, verte desnud^, correrme en, mamada~, mastúrbate, sucking his cock, sucked his cock, sucking dick, sucks dick, suck his dick, sucked his dick
PARTNER none 0.0: housewives, housewife, singles, girls, girl, milfs, teens, teen, sluts, women, chicks, babes, wives, moms, boys, hausfrauen, hausfrau, frauen, mädchen, girls, schlampen, femmes, filles, meufs, mères, mujeres, chicas, amas de casa, solteras
SOLICIT none 0.0: send me, show me, want to see, wanna see, see your, let me see, want you, want to, wanna, schick mir, zeig mir, will deine, will dein, will dich, sehen, envoie moi, montre moi, je veux, mándame, envíame, enséñame, muéstrame, quiero ver, quiero verte, quiero
NIGHT sexual 0.2: tonight, all night, all night long, heute nacht, die ganze nacht, ce soir, toute la nuit, esta noche, toda la noche, until you
near ADDR: you, u, ya, du, ihr, tu, toi, vous, eres, sos, usted, ustedes
near YOUARE: you are, you re, are you, you were, du bist, bist du, ihr seid, tu es, t es, vous êtes, tu n es, eres, sos, usted es
near HEARER: you, u, ya, du, vous, ihr
near OBJ: you, ya, u, dich, dir, euch, te, ti, vous, yourself
near OBJ2: dich, dir, euch, te, vous
near DICH: dich, euch, sie, ihn
near YOUR: your, yours, ur, dein, deine, deinen, deiner, deines, deinem, eure, euren, ton, ta, tes, votre, vos, tu, tus
near LIKE: like, wie, comme, como
near LIKEYOU: like you, like yourself, wie du, comme toi, comme vous, como tú
near MY: my, mein, meine, meinen, meiner, ma, mon, mes, mi, mis, his, her, sein, seine
near WE: i, we, ich, wir, je, on, nous, yo, somebody, someone, jemand, quelqu
near WILL: will, l, ll, gonna, going, shall, swear, should, let, werde, werden, wird, vais, va, allons, vamos, voy, va
near HE: he, she, him, her, er, sie, il, elle, él, ella
near BE: is, are, re, s, am, was, were, be, bist, ist, sind, seid, es, est, sont, êtes, eres, es, son, sois
near PLURAL: are, re, were, sind, sont, son, waren
near THOSE: those, these, such, diese, solche, jene, ces, esos, esas, estos, estas
near THEY: they, them, those, these, all, every, most, alle, diese, jene, sie, tous, toutes, ces, ils, elles, todos, todas, esos, estos, ellos, ellas
near MUST: should, must, deserve, need, ought, gehören, sollten, müssen, sollen, doivent, devraient, deben, deberían, hay, merecen, has, have
near DESERVE: deserve, deserves, verdienen, méritent, merecen
near IN: in, en, im, dans
"""

# Names of peoples and groups, with nothing bad in them; they count once.
GROUPS = """
  immigrants, immigrant, migrants, migrant, foreigners, foreigner, refugees, refugee, asylum seekers, jews, jew, jewish people, muslims, muslim, arabs, africans, asians, mexicans, turks, poles, russians, ukrainians, chinese, indians, pakistanis, romanians,
  gypsies, gypsy, roma, blacks, black people, black men, whites, white people, latinos, hispanics, gays, gay people, lesbians, homosexuals, queers, transgender people, trans people, trannies, women, feminists, disabled, the disabled, christians, catholics, hindus,
  ausländer, ausländern, flüchtlinge, flüchtlingen, migranten, einwanderer, asylanten, juden, muslime, moslems, araber, türken, polen, zigeuner, schwarze, neger, schwule, lesben, homosexuelle, frauen, behinderte, russen,
  étrangers, immigrés, migrants, réfugiés, juifs, musulmans, arabes, africains, noirs, tsiganes, roms, gitans, turcs, homosexuels, lesbiennes, gays, femmes, handicapés, chinois,
  extranjeros, inmigrantes, migrantes, refugiados, judíos, musulmanes, moros, árabes, africanos, negros, gitanos, latinos, turcos, homosexuales, lesbianas, gais, maricones, mujeres, discapacitados, chinos, mexicanos
"""

# Rules, "kind weight: CLASS gap CLASS ...".  gap is the most words between the two; with "!" none of BLOCK may be
# among them.
RULES = """
abuse 1.0: ADDR !4 INSULT
abuse 1.0: YOUARE !4 INSULT
abuse 1.0: YOUARE !3 BEAST
abuse 1.0: HEARER 0 BEAST
abuse 1.0: HEARER 0 DEMEAN 1 BEAST
abuse 0.6: DEMEAN 0 BEAST
abuse 1.0: DEMEAN !1 INSULT
abuse 1.0: INSULT 0 DEMEAN
abuse 1.0: INSULT 0 LIKEYOU
abuse 0.8: HE !0 BE !3 INSULT
abuse 1.0: YOUR 0 KIN !2 INSULT
abuse 0.7: HUSH !1 ADDR
abuse 1.0: HUSH !2 INSULT
abuse 1.0: HUSH !2 BEAST
abuse 1.0: ADDR !2 PIECE
abuse 1.0: YOUARE !4 PIECE
abuse 1.0: YOUARE !3 NOTHING
abuse 0.5: ADDR !2 DEMEAN
abuse 0.7: YOUARE !1 DEMEAN
abuse 1.0: WISH 1 ADDR !4 DIE
abuse 1.0: WISH !3 DIEYOU
abuse 1.0: WILL !3 KILL !1 OBJ
abuse 1.0: WILL 0 OBJ2 !2 KILL
abuse 1.0: OBJ2 0 WILL !1 KILL
abuse 1.0: OBJ2 3 OBJ2 !0 KILL
abuse 1.0: WILL !3 KILL 1 YOUR 0 KIN
abuse 1.0: WILL !3 KILL 0 HE
abuse 1.0: WE !1 SLAY 0 DICH !2 AWAY
abuse 1.0: WE !3 HURT 0 OBJ 2 BODY
abuse 1.0: WE !3 HURT 0 YOUR 1 BODY
abuse 1.0: WILL !3 HURT 0 YOUR 1 BODY
abuse 1.0: WILL !3 HURT !3 INBODY
abuse 1.0: HE 0 MUST 2 KILLED 3 INSULT
abuse 0.6: HE 0 MUST 2 KILLED
abuse 0.6: OBJ2 1 MUST !2 KILLED
abuse 1.0: WILL 0 OBJ2 !3 HURT 2 BODY
abuse 1.0: OBJ2 0 WILL !2 HURT 2 BODY
abuse 1.0: WILL !3 HURT 0 YOUR 0 KIN
abuse 1.0: STALK 12 HURT
abuse 1.0: STALK 12 WILL 3 KILL
hate 1.0: GROUP 2 PLURAL !3 DEHUMAN
hate 1.0: GROUP 3 PLURAL !2 CRIME
hate 1.0: GROUP 3 PLURAL !1 INFERIOR
hate 1.0: GROUP !2 NOBRAIN
hate 1.0: GROUP !4 MUST !2 KILLED
hate 1.0: GROUP !4 MUST !2 DIE
hate 1.0: GROUP !6 EXPEL
hate 1.0: GROUP !8 ERASE
hate 1.0: EXPEL 3 GROUP
hate 1.0: FOUL 0 GROUP
hate 0.7: KILL !2 GROUP
hate 0.6: UNWANTED 2 GROUP
hate 0.7: PLURAL !3 DEHUMAN
hate 0.7: PLURAL !2 DEMEAN 1 CRIME
hate 0.7: PLURAL !3 CRIME 1 DEMEAN
hate 0.6: PLURAL !3 CRIME 1 DEHUMAN
hate 0.6: CRIME 0 NATURE
hate 0.5: THEY 3 MUST !4 KILLED
hate 0.4: DEMEAN 0 DEHUMAN
hate 0.4: DEHUMAN 0 DEMEAN
hate 0.7: THOSE 0 DEHUMAN 0 DESERVE
hate 0.4: SEND 4 BACKTO
sexual 0.7: YOUR !2 ORGAN
sexual 0.7: MY !1 ORGAN
sexual 0.7: AROUSED 0 ORGAN
sexual 0.7: ORGAN 0 AROUSED
sexual 0.7: AROUSED 0 PARTNER
sexual 0.7: SEXACT !2 ORGAN
sexual 0.7: SEXACT !2 BITE
sexual 0.7: SOLICIT !2 SEXACT !1 OBJ
sexual 0.7: WILL !2 SEXACT !0 OBJ
sexual 1.0: SEXACT 0 YOUR 2 ORGAN
sexual 1.0: SEXACT 0 MY 1 ORGAN
sexual 1.0: SOLICIT !4 ORGAN
sexual 1.0: AROUSED 4 YOUR 0 ORGAN
sexual 0.4: AROUSED 0 PARTNER 6 SOLICIT 0 SEXACT
sexual 0.7: AROUSED 0 PARTNER 4 SEXACT
"""

#: No rule with "!" reaches over these.
BLOCK = "not, no, never, t, nicht, kein, keine, keinen, keiner, nie, pas, jamais, ni, nunca, jamás, if, wenn, si, treated, called, seen, behandelt, traités, tratados, i, me, ich, je, yo, us"

# Phrases whose own words never count, and terms that do not count with one of the words after ":" near.
EXCEPTIONS = """
phrases: idiot proof, idiot proofed, idiot proofing, breast cancer, breast feeding, cancer du sein, cancer de seno, sexual reproduction, sexual harassment, dumb terminal, dumb terminals, slave drive, cock a doodle, stopcock, moby dick, cum laude, summa cum laude,
  magna cum laude, pussy willow, pussy cat, great tits, blue tits, coal tits, porn filter, porn detection, hate speech, hate crime, hate crimes, bastard file, bastard cut, kill the process, comic strip, strip mall, film strip, power strip,
  nude mice, hardcore fans, naked eye, naked mole, horny toad, horny toads, dick turpin, dick van, cock fighting, cock fight, weather cock, drop dead gorgeous, drop dead date, drop dead time, drop dead deadline, kill you with kindness, kill them with kindness, kill him with kindness, kill her with kindness, kill two birds, kill time, dressed to kill, kill bill,
  guinea pig, guinea pigs, piggy bank, cash cow, cash cows, sacred cow, snake oil, blood type, blood group, blood types, garbage collection, garbage collector, garbage can, trash can, trash bin, trash folder, rat race, lab rats, lab rat, dirty data, sick leave, lazy loading, lazy evaluation, dirty flag,
  dog food, stupid printer, stupid mistake, fat client, fat tree, ugly hack, nasty bug, white papers, black and white, hard drive, hard disk, big data, hot fix, hot standby, wet paint, tight schedule,
  pros and cons, bite d amarrage, au sein, shit happens, holy shit, watching you grow, animal farm, hot dog, hot dogs, watch dog, mad cow disease
near: bitch: puppies, puppy, breeder, kennel, litter, whelp, pedigree, dog
near: cow: milk, farm, farmer, barn, herd, cattle
near: cows: milk, farm, farmer, barn, herd, cattle, dairy
near: pig: farm, farmer, iron, pork
near: pigs: farm, farmer, pork, iron
near: cock: hen, hens, rooster, valve, crow, farm, gun, ear
near: dick: bird, seed, van, tracy, detective, cheney, mr
near: tits: birds, nest, feeder, robin, species
near: nude: museum, painting, mice, sculpture, lipstick
near: naked: museum, painting, sculpture, eye, molecule
near: seins: cancer, mammographie, dépistage, allaitement
near: vermin: pest, exterminator, traps, warehouse, housing, cockroach
near: ungeziefer: schädling, kammerjäger, falle, bekämpft
near: ratten: labor, falle, gift, kanalisation
near: rats: laboratory, lab, experiment, mice, harbour, sewer, traps
near: ratas: laboratorio, plaga, trampa
near: cockroaches: pest, exterminator, traps, kitchen
near: parasites: malaria, host, worms, veterinary, organisms, plasmodium
near: animals: zoo, vet, shelter, farm, species, mice, wild
near: animales: zoo, veterinario, granja, especie, ratones, pequeños
near: animaux: zoo, vétérinaire, ferme, espèce
near: tiere: zoo, tierarzt, bauernhof, art
near: polla: gallina, gallo, huevos
near: bite: amarrage, quai, navire, insect, dog, snake
near: queue: attente, file, message, imprimante
near: schwanz: hund, katze, pferd
near: porn: detection, filter, moderation, blocklist
near: trash: folder, bin, recycling, empty
near: kill: process, server, daemon, session, task, job, script
near: cut: surgeon, doctor, operation, anaesthetic, hair
near: hit: brother, sister
near: shoot: photo, photos, film, video, picture, scene, email
near: matar: proceso, tarea, servidor
near: tuer: processus, tâche, serveur
near: violar: licencia, contrato, norma, ley
"""

_LEET = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "€": "e", "!": "i"}
_SIGNS = re.compile(r"[0345$@€7]+")
_BANG = re.compile(r"!(?=[a-z])(?<=[a-z]!)")
_HINT = re.compile(r"[ \n.\-_*][a-z0-9][ \n.\-_*]\s?[a-z0-9][ \n.\-_*]")
_APART = re.compile(r"(?<![a-z0-9])[a-z0-9](?:(?:[ .\-_*]|\n *)[a-z0-9]){2,}(?![a-z0-9])")


def _squeeze(text: str) -> str:
    """Every run of equal characters as one of them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=keep[1:])
    return codes[keep].tobytes().decode("utf-32-le", "surrogatepass")


class _Bare(dict):
    """Translation table that fills itself: look-alikes, case, width and accents go; other signs become blanks."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", to_latin(chr(code)).casefold()):
            if unicodedata.combining(c):
                continue
            kept = c.isalnum() or c in "\n.-_*$@!€"
            out.append(c if kept else " ")
        value = "".join(out)
        if len(self) < 20_000:
            self[code] = value
        return value


_BARE = _Bare({ord(">"): " "})
_WORDS = {ord(c): " " for c in "\n.-_*$@!€"}


def _bare(text: str) -> str:
    """Lower case without accents; look-alikes and invisible characters are undone."""
    return text.translate(_BARE)


def _term(text: str) -> str:
    return _squeeze(" ".join(_bare(text).translate(_WORDS).split()))


_NONE: set[str] = set()
Element = tuple[str, int, bool]
_ENDINGS = {"~": ("", "e", "s", "es", "er", "en", "em", "n"), "^": ("o", "a", "os", "as")}


def _terms(text: str) -> set[str]:
    """Folded terms of a comma list, endings written out."""
    out: set[str] = set()
    for term in map(str.strip, text.split(",")):
        endings = _ENDINGS.get(term[-1:])
        out |= {_term(term[:-1] + e) for e in endings} if endings else {_term(term)}
    return out - {""}


def _lines(text: str) -> list[tuple[str, str]]:
    """(words before the first colon, what follows it) of each entry; indented lines go on."""
    return [(m[1], m[2]) for m in re.finditer(r"^(\S[^:\n]*):((?:[^\n]*\n[ \t]+)*[^\n]*)$", text, re.M)]


class Scorer:
    """Compiled lexicon.  `score(text)` works on one message; build one per Python worker."""

    def __init__(self, lexicon: str = LEXICON, exceptions: str = EXCEPTIONS, rules: str = RULES, groups: str = GROUPS, block: str = BLOCK) -> None:
        self.classes: dict[str, set[str]] = {}  # term -> classes
        self.terms: dict[str, tuple[float, str]] = {}  # term -> weight and kind
        self.beside: dict[str, set[str]] = {}  # word or two words -> classes that are only looked up beside others
        for head, text in [*_lines(lexicon), ("GROUP hate 0.0", groups)]:
            name, kind, *weight = head.split()
            for term in _terms(text):
                if name == "near":
                    self.beside.setdefault(term, set()).add(kind)
                    continue
                self.classes.setdefault(term, set()).add(name)
                if self.terms.get(term, (-1.0, ""))[0] < float(weight[0]):
                    self.terms[term] = float(weight[0]), kind
        self.rules: dict[str, list[tuple[str, float, list[Element], int]]] = {}  # class -> rules, and its place in them
        near = set().union(*self.beside.values()) if self.beside else set()
        for head, text in _lines(rules):
            kind, weight = head.split()
            parts = text.split()
            elements = [(parts[0], 0, False)]
            elements += [(c, int(g.lstrip("!")), g[0] == "!") for g, c in zip(parts[1::2], parts[2::2], strict=True)]
            at = next(i for i, e in enumerate(elements) if e[0] not in near)
            self.rules.setdefault(elements[at][0], []).append((kind, float(weight), elements, at))
        self.block = _terms(block)
        self.excepted: set[str] = set()
        self.near: dict[str, set[str]] = {}
        for head, text in _lines(exceptions):
            if head == "phrases":
                self.excepted |= _terms(text)
            else:
                term, _, words = text.partition(":")
                self.near[_term(term)] = _terms(words)
        self.automaton = ahocorasick.Automaton()
        for term in self.classes.keys() | self.excepted:
            self.automaton.add_word(f" {term} ", term)
        self.automaton.make_automaton()
        self.words = ahocorasick.Automaton()
        for word in {w for t in [*self.classes, *self.beside] for w in t.split() if len(w) > 2}:
            self.words.add_word(word, word)
        self.words.make_automaton()

    def _join(self, m: re.Match) -> str:
        """Letters set apart, joined: what a sign joins is a word; letters between blanks are one run, in which lexicon
        words become words of their own."""
        out, run = [], ""
        for token in [*m.group().split(), ""]:
            letters = "".join(token.translate(_WORDS).split())
            if len(letters) == 1:
                run += letters
                continue
            if run:
                run, at = _squeeze(run), 0
                for end, word in self.words.iter_long(run):
                    out += [run[at : end - len(word) + 1], word]
                    at = end + 1
                out.append(run[at:])
                run = ""
            out.append(letters)
        return " " + " ".join(filter(None, out)) + " "

    @staticmethod
    def _letters(m: re.Match) -> str:
        """Signs within or beside letters, as letters; `1` stays for `_one`."""
        a, b, text = m.start(), m.end(), m.string
        if (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()):
            return "".join(_LEET.get(c, c) for c in m.group())
        return m.group()

    def _one(self, word: str) -> str:
        """A word with `1` for i or l: the reading that is a lexicon word, else i."""
        if word.isdigit():
            return word
        for letter in "il":
            if _squeeze(word.replace("1", letter)) in self.words:
                return word.replace("1", letter)
        return word.replace("1", "i")

    def fold(self, text: str) -> str:
        text = " " + _SIGNS.sub(self._letters, _bare(text)) + " "
        if "!" in text:
            text = _BANG.sub("i", text)
        if _HINT.search(text):
            text = _APART.sub(self._join, text)
        words = text.translate(_WORDS).split()
        if "1" in text:
            words = [self._one(w) if "1" in w else w for w in words]
        return _squeeze(" " + " ".join(words) + " ")

    def _hits(self, folded: str, words: list[str]) -> list[tuple[int, int, str]]:
        """(first word, end, term) of the lexicon's terms that no exception covers, in order of their ends."""
        found, at, n = [], 1, 0
        for end, term in self.automaton.iter(folded):
            n += folded.count(" ", at, end)
            at = end
            last = n + 1
            found.append((last - term.count(" ") - 1, last, term))
        barred = [(a, b) for a, b, term in found if term in self.excepted]
        hits, i = [], 0
        for a, b, term in found:
            if term not in self.classes:
                continue
            while i < len(barred) and barred[i][1] < a:
                i += 1
            if any(x <= a and b <= y for x, y in barred[i : i + 8]):
                continue
            near = self.near.get(term)
            if near and not near.isdisjoint(words[max(0, a - NEAR) : b + NEAR]):
                continue
            hits.append((a, b, term))
        return hits

    def _matches(self, words: list[str], hits: list[tuple[int, int, str]]) -> list[tuple[int, int, float, str, str]]:
        """(first word, end, weight, kind, text) of the rules that hold."""
        starts: dict[tuple[str, int], int] = {}
        ends: dict[tuple[str, int], int] = {}
        for a, b, term in hits:
            for c in self.classes[term]:
                starts[c, a] = max(b, starts.get((c, a), 0))
                ends[c, b] = min(a, ends.get((c, b), a))

        def spans(i: int) -> Iterator[tuple[int, set[str]]]:
            """Ends and classes of the words beside that begin at i."""
            yield i + 2, self.beside.get(" ".join(words[i : i + 2]), _NONE)
            yield i + 1, self.beside.get(words[i], _NONE)

        def after(c: str, at: int, gap: int, blocked: bool) -> tuple[int, int] | None:
            for i in range(at, min(at + gap + 1, len(words))):
                if (c, i) in starts:
                    return i, starts[c, i]
                for end, classes in spans(i):
                    if c in classes:
                        return i, end
                if blocked and words[i] in self.block:
                    return None
            return None

        def before(c: str, at: int, gap: int, blocked: bool) -> tuple[int, int] | None:
            for i in range(at, max(at - gap - 1, 0), -1):
                if (c, i) in ends:
                    return ends[c, i], i
                if c in self.beside.get(words[i - 1], _NONE):
                    return i - 1, i
                if i > 1 and c in self.beside.get(words[i - 2] + " " + words[i - 1], _NONE):
                    return i - 2, i
                if blocked and words[i - 1] in self.block:
                    return None
            return None

        out = []
        for a, b, term in hits:
            for c in self.classes[term]:
                for kind, weight, elements, at in self.rules.get(c, ()):
                    first, end, ok = a, b, True
                    for j in range(at, 0, -1):
                        step = before(elements[j - 1][0], first, elements[j][1], elements[j][2])
                        if step is None:
                            ok = False
                            break
                        first = step[0]
                    for j in range(at + 1, len(elements) if ok else 0):
                        step = after(elements[j][0], end, elements[j][1], elements[j][2])
                        if step is None:
                            ok = False
                            break
                        end = step[1]
                    if ok:
                        out.append((first, end, weight, kind, " ".join(words[first:end])))
        return out

    def score(self, text: str | None) -> tuple[float, float, str | None, list[str]]:
        """Score, weight per 1,000 words, the kind of most weight (null if none) and the distinct terms found."""
        parts = visible(text)
        if not parts:
            return 0.0, 0.0, None, []
        folded = self.fold("\n\n".join(parts))
        words = folded.split()
        hits = self._hits(folded, words)
        marks = self._matches(words, hits)
        marks += [(a, b, *self.terms[term], term) for a, b, term in hits if self.terms[term][0] > 0]
        if not marks:
            return 0.0, 0.0, None, []
        # what lies within a heavier mark doesn't count again; a heavier one within a lighter takes its place
        marks.sort(key=lambda m: (m[0], -m[1], -m[2]))
        kept: list[tuple[int, int, float, str, str]] = []
        for m in marks:
            if kept and m[1] <= kept[-1][1]:
                if m[2] > kept[-1][2]:
                    kept[-1] = (*kept[-1][:2], *m[2:])
                continue
            kept.append(m)
        best, best_kind = 0.0, ""
        for i in range(len(kept)):
            terms: dict[str, tuple[float, str]] = {}
            total = 0.0
            for j in range(i, len(kept)):
                length = kept[j][1] - kept[i][0]
                if length >= 2 * WINDOW:  # the densest stretch of at least WINDOW words is shorter than two of them
                    break
                _, _, weight, kind, term = kept[j]
                had = terms.get(term, (0.0, ""))[0]
                if weight > had:
                    terms[term] = weight, kind
                    total += weight - had
                density = total * WINDOW / max(WINDOW, length)
                if density > best + 1e-9:
                    kinds: dict[str, float] = {}
                    for w, k in terms.values():
                        kinds[k] = w + kinds.get(k, 0.0)
                    best, best_kind = density, max(sorted(kinds), key=kinds.__getitem__)
        total = sum(m[2] for m in kept)
        return round(best, 4), round(1000 * total / max(1, len(words)), 4), best_kind, sorted({m[4] for m in kept})





_SCORERS: dict[tuple[str, ...], Scorer] = {}


def _scorer(*lists: str) -> Scorer:
    if lists not in _SCORERS:
        _SCORERS[lists] = Scorer(*lists)
    return _SCORERS[lists]


def score_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    lexicon: str = LEXICON,
    exceptions: str = EXCEPTIONS,
    rules: str = RULES,
    groups: str = GROUPS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each row of docs: id, `keep` columns, score, per_1000, kind, terms, flagged.

    Null and empty texts score 0 and are not flagged; repeated rows and null ids are rows like any other.  Columns of docs
    that are not named are not read.
    """
    picked = spread(docs.select(F.col(id_column), *[F.col(c) for c in keep], F.col(text_column).alias("__text")))
    out = [picked.schema[i] for i in range(1 + len(keep))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(lexicon, exceptions, rules, groups)
        for batch in batches:
            rows = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            score, rate, kind, terms = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(score, pa.float64()),
                    pa.array(rate, pa.float64()),
                    pa.array(kind, pa.string()),
                    pa.array(terms, pa.list_(pa.string())),
                ],
                [*batch.schema.names[:-1], "score", "per_1000", "kind", "terms"],
            )

    scored = picked.mapInArrow(run, f"{schema}, score double, per_1000 double, kind string, terms array<string>")
    return scored.withColumn("flagged", F.col("score") >= F.lit(threshold))


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Documents, flagged documents and the rate for each value of `by`; null is a value of its own."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.col("flagged").cast("bigint")).alias("n_flagged"),
        F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"),
        F.round(F.max("score"), 4).alias("max_score"),
    )
