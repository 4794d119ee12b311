"""The small labelled table the tagger learns from: sentences with marked mentions, and rules that invent the values.

A mark in braces stands for a mention of that type; sentences without marks are counter-examples. All sentences were written for this table. ``SENTENCES``,
``COUNTER`` and the parts to put together train the tagger; ``HELD_OUT`` and ``HELD_OUT_COUNTER`` are other sentences, which it never sees and which the tests judge it by.
Names come from common given names and family names and from syllables, numbers from the public formats of several countries.
"""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

from turnloom.llm.transcript import CLIENT_WORDS, SPEAKER_WORDS, THERAPIST_WORDS

SENTENCES = """
If anything comes up, {email} reaches me within a day.
Please forward the invoice to {email}, thanks.
He keeps two accounts, {email} and {email}.
Reply to {email} rather than to the shared inbox.
Her new mailbox is {email}.
The newsletter arrived from {email} again.
Somebody logged in as {email} last weekend.
Could you copy in {email} when you answer?
E-mail: {email}
Email address {email}, phone {phone}.
Mail goes to {email}; parcels go to {address}.
From: {email}
{email} is the one I check.
I signed up with {email} because the other one was full.
She spelled it out for me: {email}.
You can reach my sister under {email}, she always replies.
Puede enviarme el documento a {email}, por favor.
Mi dirección nueva es {email}.
Tengo dos cuentas y la buena es {email}.
Envoyez le dossier à {email}, s'il vous plaît.
Ma nouvelle adresse électronique est {email}.
Il répond toujours depuis {email}.
Schicken Sie die Unterlagen bitte an {email}.
Die neue Adresse lautet {email}, die alte ist gesperrt.
Er antwortet immer von {email} aus.
Mande o formulário para {email}, por favor.
O endereço novo é {email}.
Ela responde sempre de {email}.
कृपया दस्तावेज़ {email} पर भेज दीजिए।
मेरा नया पता {email} है।
ஆவணங்களை {email} க்கு அனுப்புங்கள்.
என் புதிய முகவரி {email}.
The quickest way is to dial {phone}.
My cell is {phone}, text is fine too.
Someone left a voicemail from {phone}.
If nobody opens, try {phone} instead.
The landline, {phone}, was cut off in winter.
We swapped numbers and hers is {phone}.
Missed three calls from {phone} this morning.
Fax {phone}
Phone: {phone}
Mobile number {phone}; works nights.
The crisis contact listed is {person} on {phone}.
Text me at {phone} when you arrive.
So I dialled {phone} and nobody answered.
It is {phone}, shall I say that again?
You reach the landlord at {phone}, his name is {person}.
{phone} is my work number.
Out of hours: {phone}
Mi móvil es {phone}, mándeme un mensaje.
El teléfono de mi hija es {phone}.
Llame al {phone} si no abro la puerta.
Mon portable, c'est le {phone}, envoyez un message.
Le téléphone de ma fille est le {phone}.
Appelez le {phone} si je n'ouvre pas.
Mein Handy hat die {phone}, schreiben Sie mir.
Die Nummer meiner Tochter ist {phone}.
Rufen Sie {phone} an, wenn niemand öffnet.
Meu celular é {phone}, mande uma mensagem.
O telefone da minha filha é {phone}.
Ligue para {phone} se eu não abrir.
मेरा मोबाइल {phone} है, संदेश भेज दीजिए।
दरवाज़ा न खुले तो {phone} पर फ़ोन करें।
என் கைபேசி {phone}, செய்தி அனுப்புங்கள்.
கதவு திறக்கவில்லை என்றால் {phone} க்கு அழையுங்கள்.
The benefits office has me down as {id}.
My tax number, {id}, was printed on the letter.
Under the photo it said {id}.
For the claim I needed {id} and a signature.
He read {id} off the card, slowly.
Driving licence {id}, valid another year.
Passport no. {id}
National insurance: {id}
SSN {id}
Health card {id} was lost on the train.
They mixed up {id} with {id}, which is my brother.
I know it by heart: {id}.
Her identity card shows {id}, so the bank was satisfied.
Aadhaar {id}, PAN {id}.
The record is kept under {id} at the hospital.
{id} is what they stamped on the form.
Mi número de afiliado es {id}, lo sé de memoria.
En el pasaporte pone {id}.
Perdí el carné, era el {id}.
Mon numéro fiscal est {id}, je le connais par cœur.
Sur le passeport il y a {id}.
J'ai perdu ma carte, c'était la {id}.
Meine Steuernummer lautet {id}, die kenne ich auswendig.
Im Ausweis steht {id}.
Ich habe die Karte verloren, es war {id}.
O meu número fiscal é {id}, sei de cor.
No passaporte está {id}.
Perdi o cartão, era o {id}.
मेरा कर नंबर {id} है, मुझे याद है।
पासपोर्ट में {id} लिखा है।
என் வரி எண் {id}, எனக்கு நினைவிருக்கிறது.
கடவுச்சீட்டில் {id} என்று உள்ளது.
Our old house was {address}.
They found the car outside {address}, unlocked.
Deliver it to {address}, ring twice.
The hostel at {address} had no beds.
I rent a room at {address} from {person}.
Home address: {address}
Registered at {address} since autumn.
From {address} it takes me an hour by bus.
We grew up on the corner, {address}, above the bakery.
The surveyor came round to {address} yesterday.
Because {address} is damp, the children cough.
My parents still own {address}.
Discharged to {address}, keys with {person}.
You know the place, {address}, by the canal.
Vivimos en la {address_es}, encima de la panadería.
La carta llegó a la {address_es}.
El piso de la {address_es} es muy frío.
Nous habitons {address_fr}, au-dessus de la boulangerie.
La lettre est arrivée au {address_fr}.
L'appartement du {address_fr} est très froid.
Wir wohnen {address_de}, über der Bäckerei.
Der Brief kam in die {address_de}.
Die Wohnung in der {address_de} ist sehr kalt.
Moramos na {address_pt}, em cima da padaria.
A carta chegou na {address_pt}.
O apartamento da {address_pt} é muito frio.
हम {address} में रहते हैं, ऊपर वाली मंज़िल पर।
चिट्ठी {address} पर आई।
நாங்கள் {address} இல் இருக்கிறோம்.
கடிதம் {address} க்கு வந்தது.
The letter was signed by {person}.
I trust {person} more than anybody.
{person} rang while I was cooking.
{person} never apologised for it.
Then {person} came round with soup.
She married {person} in secret.
We were waiting for {person} at the station.
My brother {person} lent me the money.
My friend {person} thinks I should leave.
His boss, {person}, shouts at everybody.
Her daughter {person} starts school soon.
A colleague called {person} covered my shift.
Ever since {person} died, the house is quiet.
I shared a flat with {person} for two years.
They asked {person} and {person} to be witnesses.
It is because of {person} that I stopped.
What would {person} say if they heard this?
I saw {person}.
Me and {person} had a row about the dishes.
I owe {person} an apology.
He works for {person} in the warehouse.
Nobody believed {person} at first.
I dreamed that {person} was standing by the door.
The nurse on duty was {person}.
Do you remember {person} from school?
Told {person} everything, felt lighter.
Name: {person}
Emergency contact: {person} ({phone})
Seen by {person} for the assessment.
Lives with partner {person} and two cats.
Mother {person} attended the first part.
Letter from {person} received and filed.
Spoke to {person}, who agrees with the plan.
cc: {person}
Allocated to {person} after the holidays.
Handover from {person}; see her summary.
Key worker {person}, solicitor {person}.
Consent given for contact with {person}.
Former partner {person} has moved abroad.
Attends with interpreter {person}.
Confío en {person} más que en nadie.
Entonces llegó {person} con la sopa.
Mi hermano {person} me prestó el dinero.
La carta la firmó {person}.
Desde que murió {person}, la casa está callada.
Comparto piso con {person} y nos llevamos bien.
Je fais confiance à {person} plus qu'à quiconque.
Alors {person} est arrivé avec la soupe.
Mon frère {person} m'a prêté l'argent.
La lettre était signée par {person}.
Depuis la mort de {person}, la maison est calme.
Je partage un appartement avec {person} et ça va.
Ich vertraue {person} mehr als allen anderen.
Dann kam {person} mit der Suppe.
Mein Bruder {person} hat mir das Geld geliehen.
Der Brief war von {person} unterschrieben.
Seit {person} gestorben ist, ist es still im Haus.
Ich teile mir die Wohnung mit {person} und es geht gut.
Confio em {person} mais do que em qualquer um.
Então chegou {person} com a sopa.
Meu irmão {person} me emprestou o dinheiro.
A carta foi assinada por {person}.
Desde que {person} morreu, a casa está quieta.
Divido o apartamento com {person} e nos damos bem.
मुझे {person} पर सबसे ज़्यादा भरोसा है।
फिर {person} सूप लेकर आया।
मेरे भाई {person} ने मुझे पैसे उधार दिए।
मैं {person} के साथ घर में रहता हूँ।
நான் {person} ஐ மிகவும் நம்புகிறேன்.
பிறகு {person} சூப்புடன் வந்தார்.
என் சகோதரர் {person} எனக்குப் பணம் கொடுத்தார்.
நான் {person} உடன் வீட்டைப் பகிர்கிறேன்.
""".strip().split("\n")

COUNTER = """
The kettle takes 3 minutes and then it clicks off.
I slept 6 hours, give or take.
He paid 45,000 for the van and sold it for 38,200.
The meeting on 2019-08-27 was cancelled.
We began at 09:30 and finished around 10:45.
Look at chapter 4, pages 210 to 233.
Ward 12 has 24 beds.
She weighs 62.5 kg, up from 58.
My mark went from 11 to 7 out of 27.
The dose is 75 mg at 08:00 and 20:00.
The fridge was set to 4 degrees.
Bus 176 stops there every 20 minutes.
On 14 July 2018 we signed the lease.
Platform 9, carriage 3, seat 41.
Between 1998 and 2004 I lived abroad.
Quote {code} if they ask.
The folder marked {code} belongs to another case.
Filed under {code}, see also {code}.
Participant {code} dropped out in week 5.
Recording {code} is too noisy to use.
Study arm {code}, baseline visit.
Sample {code} was stored at minus 20.
Reference {code}: reviewed and closed.
They moved me from group {code} to group {code}.
Codes {code} and {code} were entered twice.
My contact is {hidden}, as you know.
I told {hidden} that I was sorry.
Write to {hidden} at {hidden}.
{hidden} was there too.
The number {hidden} is already on file.
My cousin fixed the roof on Saturday.
My husband and my aunt do not speak.
The doctor said it was nothing serious.
The social worker will call again on Thursday.
A neighbour complained about the noise.
My best friend from work knows about it.
The teacher wrote a note about my son.
Our landlady raised the rent in January.
I crossed the street and sat on a bench near the road.
The lane behind the house floods every autumn.
There is a box of letters under the stairs.
Nothing on the drive home made sense to me.
In Spain it was warm, in Germany it rained.
I learned French at school and Italian from songs.
At Christmas we all pretend.
On Mondays I feel it the most.
The Hospital changed the rules in March.
Cognitive therapy was offered, Mindfulness was declined.
Who would have thought that?
How did that make you feel?
When did you first notice it?
What happened after that?
Where were you sitting?
Why now?
Can you say a bit more about the second one?
Would it be fair to call that relief?
Let us go back to the list from last time.
Tell me about the week.
That sounds exhausting.
It seems to me that you were protecting her.
So, on the one hand you want rest, and on the other you want company.
Right, and the part about the money?
Okay. Yes. No. Maybe.
Well, anyway, it passed.
Sure, I can try.
Exactly!
Never again.
Thank you, see you next time.
Sometimes I just stare at the wall.
Perhaps it was the weather.
Because of the rain we stayed in.
After supper I washed up, then I cried.
Before the surgery I was a different person.
Even so, I got up and fed the dog.
Although I was scared, I opened the letter.
Everything felt heavy, everything took ages.
Nobody warned me about the side effects.
Honestly, I would rather not.
Yesterday was worse than today.
Tomorrow I will ask for a refund.
Lately the mornings are easier.
Once a week I visit the allotment and dig.
Drinking less, sleeping more, walking daily.
Feels guilty about shouting at the kids.
Denies thoughts of self-harm; future plans intact.
Presented as tired but engaged throughout.
Goals: return to work, reduce checking, cook twice a week.
Progress slow; barriers include debt, pain and childcare.
Plan agreed: breathing exercise before bed, review in a fortnight.
Appetite poor. Sleep broken. Motivation improving.
No show, second in a row. Voicemail left.
Rapport good; silence tolerated better than before.
Discussed boundaries with family of origin.
Formulation shared and amended together.
Rated the alliance 8 and the mood 5.
Outcome measures completed at intake, mid-point and close.
Supervision notes: countertransference noticed, to be revisited.
Summary
Session 12
Transcript
Audio file 0031.mp3
Recorded with two microphones in the small office.
00:04:31.200 --> 00:04:36.900
12
Speaker 2 [00:14:07]
No recording available.
WEBVTT
NOTE exported by the recorder
Interview, part 2 of 3
Two goals were set: fewer rows, more rest.
One thing helped: writing it down.
I kept thinking: what if it happens again?
First the heart races, then the hands shake.
zero to ten, I would say four, maybe five.
One, two, three, and then I breathe out.
It was two or three days, no, four.
I counted to nine and went in.
You gave it a seven, what would make it an eight?
She said at first it was fine, dot dot dot, and then it was not.
I looked at the sky and at the dot on the ceiling.
No sé qué decirle a mi madre cuando pregunta.
Ayer fue peor que hoy, pero salí a caminar.
¿Cuándo empezó a notarlo?
¿Y qué pasó después de la cena?
Mi primo arregló el techo el sábado.
Me siento culpable por haber gritado a los niños.
Quizás era el cansancio, quizás otra cosa.
Duermo seis horas y me levanto agotado.
El médico dijo que no era nada grave.
Vamos a volver a la lista de la otra vez.
Siempre me pasa lo mismo los lunes.
Prefiero no hablar de la deuda todavía.
Cuando llueve me quedo en casa y leo.
Una parte de mí quiere descansar.
Je ne sais pas quoi dire à ma mère quand elle demande.
Hier c'était pire qu'aujourd'hui, mais je suis sorti.
Quand avez-vous commencé à le remarquer ?
Et que s'est-il passé après le dîner ?
Mon cousin a réparé le toit samedi.
Je me sens coupable d'avoir crié sur les enfants.
Peut-être que c'était la fatigue, peut-être autre chose.
Je dors six heures et je me lève épuisé.
Le médecin a dit que ce n'était rien de grave.
Revenons à la liste de la dernière fois.
C'est toujours pareil le lundi.
Je préfère ne pas parler de la dette pour l'instant.
Quand il pleut, je reste chez moi et je lis.
Une partie de moi veut se reposer.
Ich weiß nicht, was ich meiner Mutter sagen soll, wenn sie fragt.
Gestern war es schlimmer als heute, aber ich bin rausgegangen.
Wann haben Sie das zuerst bemerkt?
Und was geschah nach dem Abendessen?
Mein Vetter hat am Samstag das Dach repariert.
Ich habe ein schlechtes Gewissen, weil ich die Kinder angeschrien habe.
Vielleicht war es die Müdigkeit, vielleicht etwas anderes.
Ich schlafe sechs Stunden und stehe erschöpft auf.
Der Arzt meinte, es sei nichts Ernstes.
Gehen wir zurück zur Liste vom letzten Mal.
Am Montag ist es immer dasselbe.
Über die Schulden möchte ich noch nicht reden.
Wenn es regnet, bleibe ich zu Hause und lese.
Ein Teil von mir will Ruhe, der andere will Gesellschaft.
Die Angst vor der Prüfung hat mit dem Streit im Büro zu tun.
Das Gespräch mit der Chefin war ein Schritt nach vorn.
Não sei o que dizer à minha mãe quando ela pergunta.
Ontem foi pior do que hoje, mas eu saí para andar.
Quando começou a perceber isso?
E o que aconteceu depois do jantar?
Meu primo consertou o telhado no sábado.
Eu me sinto culpado por ter gritado com as crianças.
Talvez fosse o cansaço, talvez outra coisa.
Durmo seis horas e acordo exausto.
O médico disse que não era nada grave.
Vamos voltar à lista da outra vez.
Na segunda-feira é sempre igual.
Prefiro não falar da dívida ainda.
Quando chove fico em casa e leio.
Uma parte de mim quer descansar.
मुझे नहीं पता माँ के पूछने पर क्या कहूँ।
कल आज से ज़्यादा बुरा था, लेकिन मैं बाहर निकला।
आपने यह पहली बार कब देखा?
और रात के खाने के बाद क्या हुआ?
डॉक्टर ने कहा कि कोई गंभीर बात नहीं है।
मैं छह घंटे सोता हूँ और थका हुआ उठता हूँ।
बच्चों पर चिल्लाने का मुझे अफ़सोस है।
बारिश में मैं घर पर रहकर पढ़ता हूँ।
அம்மா கேட்கும்போது என்ன சொல்வது என்று தெரியவில்லை.
நேற்று இன்றைவிட மோசமாக இருந்தது, ஆனால் வெளியே சென்றேன்.
நீங்கள் இதை முதலில் எப்போது கவனித்தீர்கள்?
இரவு உணவுக்குப் பிறகு என்ன நடந்தது?
மருத்துவர் பெரிய பிரச்சினை இல்லை என்றார்.
நான் ஆறு மணி நேரம் தூங்குகிறேன்.
குழந்தைகளிடம் கத்தியதற்கு வருந்துகிறேன்.
மழை பெய்தால் வீட்டில் இருந்து படிக்கிறேன்.
""".strip().split("\n")

# What may stand before and behind a mention; sentences are also put together from these.
BEFORE = {
    "person": """I saw|I called|I told|I asked|we met|they blamed|she left|he hit|I miss|I love|I hate|I thanked|I envy|I lied to|I spoke to|I wrote to|I ran into|I was rude to|my cousin|my niece|my nephew|my grandson|my ex|my boss|our neighbour|his sister
her husband|my partner|my dad|my stepmother|my flatmate|my son|my daughter|his wife|the manager|the teacher|the lawyer|the psychiatrist|a guy named|a woman called|somebody named|a girl called|because of|close to|away from|talk to|talking to|listening to|afraid of
angry with|proud of|jealous of|dinner with|in front of|without|except for|thanks to|looking after|engaged to|living with|a letter from|news about|a photo of|home with|what about|says|said|according to|from|to|for|with|by|about|and|or|like|than|not even
only|maybe|even|when|if|that|while|because|since|until|before|after|so|then|today|it was|it is|there is|was it|between me and|both me and|as for|remember|met|saw|told|asked|kissed|married|hurt|believes|thinks|Client lives with|Supported by|Accompanied by|Referred to|Agreed with|Letter sent to|Call from
Meeting with|Feels safe with|Conflict with|Father|Sister|Brother|Sibling|Partner|Spouse|Parent|Guardian|Mentor|Sponsor|Supervisor|Neighbour|Colleague|Ex-husband|last week|last night|yesterday|this morning|two days ago|at first|my supervisor|my neighbour|my mentor|Carer|Friend|Employer|Contact person|Signed:|Seen by:|hablé con|vi a|llamé a|quiero a|le dije a|mi prima|mi vecino|mi jefe|con|para|sin|según|y|pero|cuando|porque|como|gracias a|mi hija|mi novio|j'ai vu|j'ai appelé|j'aime|j'ai dit à
ma cousine|mon voisin|mon chef|avec|pour|sans|selon|et|mais|quand|parce que|grâce à|ma fille|chez|ich sah|ich rief|ich liebe|ich sagte zu|meine Kusine|mein Nachbar|mein Chef|mit|für|ohne|laut|und|aber|wenn|weil|dank|meine Tochter|bei|von|falei com|vi|liguei para|amo|disse a|minha prima|meu vizinho|meu chefe
com|sem|segundo|e|mas|quando|porque|graças a|minha filha|मैंने|मेरी बहन|मेरे दोस्त|लेकिन|और|என் அக்கா|என் நண்பர்|ஆனால்""",
    "phone": """it is|it was|number|the number|my number is|her number|his number is|call|ring|text|dial|phone|reach me on|reach him at|on|at|to|under|is it|still|use|try|not|or|and|got|gave me|wrote down|saved|changed it to|from|tel|Tel.|mobile|fax|home|work|office|WhatsApp|cell|number on file:|Best number
es|el número es|llámame al|teléfono|al|c'est|mon numéro est|appelle le|téléphone|au|die Nummer ist|ruf|Telefon|unter|é|o número é|ligue|telefone|no|नंबर|फ़ोन|எண்|தொலைபேசி""",
    "id": """ID|card|number|passport|licence|insurance|tax|under|it says|says|is|was|shows|has|with|reads|read out|typed|gave them|issued|renewed|lost|for|my number,|the number|social security|NI|member|policy|patient no.|ID no.|document|identity card|visa|permit|and|or|not|NHS|número|documento|pasaporte|el carné|seguro
numéro|passeport|carte|assurance|Nummer|Ausweis|Pass|Versicherung|número de|passaporte|cartão|seguro social|नंबर|आधार|எண்|அட்டை""",
    "address": """at|to|from|near|outside|to the house at|by|past|opposite|behind|bought|sold|rent|rented|own|owns|lives at|live at|living at|moved to|moving from|visit to|address|my address is|the address|sent to|send it to|is|was|remember|know|walked to|drove to|on|in|Address:|Lives:|Moved:|home is|staying at|mail to|since we left""",
    "email": """at|to|from|is|was|it's|email|mail|write to|wrote to|send it to|use|try|checked|via|under|account|login|E-mail|Mail:|and|or|not|from:|contact|message|to my address|correo|a|escriba a|courriel|à|écris à|Mail an|an|schreib an|para|escreva para|ईमेल|மின்னஞ்சல்""",
    "address_es": "en la|vivo en la|a la|de la|hasta la|por la|junto a la|casa:|dirección:",
    "address_pt": "na|moro na|para a|da|até a|pela|perto da|casa:|endereço:",
    "address_fr": "au|j'habite au|du|jusqu'au|vers le|près du|adresse :|chez moi,",
    "address_de": "in der|ich wohne in der|zur|aus der|bis zur|nahe der|Adresse:|zu Hause,",
}
BEFORE = {k: [x for line in v.split("\n") for x in line.split("|")] for k, v in BEFORE.items()}
BEHIND = """said no|laughed|cried|was there|is kind|was late|has moved out|knows everything|told me to stop|will come|might help|did not answer|called me lazy|made tea|was drunk|is my rock|and me|and I|for hours|last night|on Sunday|at the party|in the kitchen|again|every day|, I think|, you know|, right|who lives abroad
because I was scared|to help me|after work|the other day|please|today|yesterday|last week|and waited|but nothing happened|now|once|twice|instead|is wrong|is right|works|was better|so I left|which was new|if you can|until May|since June|then|a lot|so much|anyway|.|.|.|.|?|!|;| -|)|y nada más|pero no|otra vez|ayer|dijo que no|et rien
mais non|encore|hier|a dit non|und nichts|aber nein|wieder|gestern|sagte nein|e nada|mas não|de novo|ontem|disse não|से|ने कहा|के साथ|को|உடன்|சொன்னார்|இடம்""".replace("\n", "|").split("|")  # fmt: skip
PLAIN = """my sister|the doctor|the neighbours|a colleague|him|her|them|nobody|everyone|the dog|Monday|Tuesday|Friday|January|August|Christmas|Easter|London|Paris|Berlin|Madrid|Lisbon|Delhi|Chennai|Spain|France|Germany|Brazil|India|English|French|Spanish|the GP|the Council|Mum|Dad|God|the Internet|work|school|therapy|Mother|Father|Grandma
my manager|the team|my ex|the children|my husband|my wife|the flat|the bank|the letter|the phone|a friend|someone|the kids|my parents|the pills|my head|the past|that night|wine|sleep|myself|you|us|it|this|the group|the hospital|the court|the police|the landlord|my mother|my father|mi madre|mi hermana|el médico|ella|nadie|los niños|el trabajo
ma mère|ma sœur|le médecin|elle|personne|les enfants|le travail|meine Mutter|meine Schwester|der Arzt|ihr|niemand|die Kinder|die Arbeit|der Chef|das Haus|Arbeit|Schlaf|Angst|minha mãe|minha irmã|o médico|ela|ninguém|as crianças|o trabalho|माँ|बहन|डॉक्टर|बच्चे|அம்மா|தங்கை|மருத்துவர்|குழந்தைகள்|three weeks|12 of them|40 minutes|1,500|2016|8 out of 10|50 mg|7.30|200 a week|350 a month|30 a day|4 in the morning|10 percent|65 kilos|100 euros|two days|three months|drei Tage|dos días|deux jours|dois dias
page 14|room 6|bus 9|week 3|item 5|level 2""".replace("\n", "|").split("|")  # fmt: skip

# Ordinary words of each language; counter-examples are also drawn from these at random.
ORDINARY = {
    "en": """tired anxious calm angry sad lonely ashamed guilty relieved hopeful worried numb restless steady scared proud hurt curious stuck overwhelmed exhausted better worse always never often sometimes rarely again still already almost quite really maybe perhaps therefore
however although unless whether while during between against toward without within about above under behind beyond because since until through morning afternoon evening night midnight noon weekend summer winter autumn spring holiday birthday funeral wedding exam divorce separation custody
mother father sister brother daughter son uncle aunt cousin partner husband wife friend boss manager colleague neighbour teacher nurse doctor therapist landlord flatmate child children parents family team group office kitchen hallway garden bedroom bathroom stairs window door car train bus station street road school
college university hospital clinic court church shop market gym park beach city town village country work job money debt rent bill letter phone message call meeting appointment session homework diary list plan goal step habit routine walk sleep food appetite weight pain headache chest stomach breath
heart hands head voice eyes tears anger fear panic shame guilt grief hope trust love hate drink drinking smoking gambling alcohol wine beer cigarette pill tablets medication dose side effects mood energy concentration motivation irritability memory attention change reason choice chance
promise argument conflict silence noise rain weather dog cat book music film game news internet screen app group thing nothing something everything anyone somebody nobody everybody myself yourself himself herself itself themselves want wanted need needed feel felt think thought know knew
say said tell told ask asked answer answered talk talked listen listened notice noticed remember remembered forget forgot understand understood believe decide decided try tried start started stop stopped keep kept leave left stay stayed come came go went bring brought take took give gave get got make made
let put set sit sat stand stood walk run ran eat ate drank slept woke cried laughed shouted whispered waited watched read wrote cooked cleaned paid owed bought sold lost found broke fixed closed opened moved changed helped hurt avoided managed finished reviewed discussed explored agreed reported described
attended arrived declined completed improved worsened remains continues presented risk screen referral assessment intake discharge consent boundary strategy exercise breathing relapse craving trigger urge reflection summary feedback supervision alliance formulation baseline progress setback""",
    "es": """cansado cansada triste tranquilo tranquila solo sola culpable ansioso ansiosa nervioso nerviosa enfadado enfadada agotado agotada inquieto inquieta avergonzado avergonzada aliviado aliviada orgulloso preocupado preocupada bloqueado perdido mejor peor siempre nunca todavía también quizás casi luego entonces
después antes durante desde hasta mañana tarde noche ayer hoy anoche semana mes año verano invierno primavera otoño lunes martes miércoles jueves viernes sábado domingo madre padre hermana hermano hija hijo tío tía prima primo pareja marido esposa amigo amiga jefe jefa compañero compañera vecino vecina
maestra enfermera médico terapeuta niños familia equipo grupo oficina cocina pasillo jardín cuarto casa puerta ventana coche tren calle escuela hospital clínica trabajo dinero deuda alquiler carta teléfono mensaje llamada reunión cita sesión tarea diario lista plan meta paso costumbre paseo sueño comida
apetito peso dolor cabeza pecho estómago corazón manos voz ojos rabia miedo pánico vergüenza culpa duelo esperanza confianza amor alcohol vino cigarrillo pastillas tratamiento insomnio mudanza separación divorcio examen pregunta silencio lluvia perro libro nada algo todo nadie alguien quiero quería
necesito siento sentí sentía pienso pensé sé sabía digo dije dijo decir cuento conté contó pregunto preguntó contesté hablo hablé hablar escucho noto noté recuerdo olvido entiendo creo decidí intento intentar empecé empezar dejé dejar salgo salí salir vuelvo volví volver termino terminé terminar llego llegué
llegar duermo dormí dormir uno dos tres cuatro cinco seis siete ocho nueve diez días horas minutos despierto desperté lloro lloré grité espero leo escribo anote anotar cuando cuándo cómo qué quién dónde porque aunque mientras según entre contra sobre usted ustedes nosotros ellos ellas esto eso aquello mucho poco bastante demasiado importante difícil fácil nuevo viejo otra otro cada misma mismo parece
sienta sentirse haya hubiera podría debería gustaría ayuda ayudó seguir adelante cambio cambiar beber fumar comer caminar parte espacio momento próxima última verdad cuerpo""",
    "fr": """fatigué fatiguée triste calme seul seule coupable anxieux anxieuse nerveux nerveuse fâché fâchée épuisé épuisée inquiet inquiète honteux honteuse soulagé soulagée fier fière perdu perdue bloqué tranquille apaisé apaisée mieux pire toujours jamais encore aussi presque ensuite alors après avant pendant depuis jusque matin soir
nuit hier aujourd'hui demain semaine mois année été hiver printemps automne lundi mardi mercredi jeudi vendredi samedi dimanche mère père sœur frère fille fils oncle tante cousine cousin compagnon compagne mari femme ami amie chef collègue voisin voisine maîtresse infirmière infirmier médecin thérapeute enfants famille
équipe groupe bureau cuisine couloir jardin chambre maison porte fenêtre voiture train rue école hôpital clinique travail argent dette loyer lettre téléphone message appel réunion séance devoir journal liste plan but pas habitude promenade sommeil repas appétit poids douleur tête poitrine ventre cœur mains voix yeux
colère peur panique honte culpabilité deuil espoir confiance amour alcool vin cigarette cachets traitement insomnie déménagement séparation divorce examen question silence pluie chien livre rien quelque chose tout personne quelqu'un veux voulais besoin sens sentais sentez sentir senti pense pensais pensé sais savais dis
disait dit dire raconte raconté demande demandé réponds parle parlé parler écoute remarque remarqué rappelle oublie comprends crois décidé essaie essayer essayé commence commencé commencer arrête arrêté arrêter laisse sors sorti sortir reviens revenu revenir finis fini finir arrive arrivé arriver dors dormi dormir deux trois quatre cinq six sept huit neuf dix jours heures minutes réveille
pleure pleuré crié attends lis écris notez noter quand comment quoi qui où parce puisque pourtant tandis selon entre contre sur vous nous ils elles cela ceci beaucoup peu assez trop important difficile facile nouveau vieux autre chaque même semble aurait pourrait devrait aimerais aimerait voudrais pourrais devrais aide aidé suis étais
serais avais aurais continuer changement changer boire fumer manger marcher partie place moment prochaine dernière vérité corps j'aimerais j'étais j'avais j'arrive j'essaie l'alcool l'argent l'école d'autre d'abord c'était n'arrive n'ai qu'est s'est""",
    "de": """müde traurig ruhig allein schuldig ängstlich nervös wütend erschöpft unruhig beschämt erleichtert stolz verloren blockiert einsam überfordert angespannt gelassen besser schlechter immer nie noch auch fast dann danach davor während seit bis morgens abends nachts gestern heute morgen früher später jetzt bald vielleicht trotzdem
deshalb obwohl weil wenn ob dass damit ohne gegen zwischen über unter wegen Morgen Abend Nacht Woche Monat Jahr Sommer Winter Frühling Herbst Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Mutter Vater Schwester Bruder Tochter Sohn Onkel Tante Kusine Vetter Partner Partnerin Mann Frau Freund Freundin Chef Chefin
Kollege Kollegin Nachbar Nachbarin Lehrer Lehrerin Pfleger Pflegerin Arzt Ärztin Therapeut Kinder Kind Eltern Familie Team Gruppe Büro Küche Flur Garten Zimmer Haus Wohnung Tür Fenster Auto Zug Bus Straße Schule Klinik Krankenhaus Arbeit Geld Schulden Miete Brief Telefon Nachricht Anruf Treffen Termin Sitzung Stunde Aufgabe
Tagebuch Liste Plan Ziel Schritt Gewohnheit Spaziergang Schlaf Essen Appetit Gewicht Schmerz Kopf Brust Bauch Herz Hände Stimme Augen Körper Wut Angst Panik Scham Schuld Trauer Hoffnung Vertrauen Liebe Alkohol Trinken Rauchen Wein Zigarette Tabletten Behandlung Umzug Trennung Scheidung Prüfung Frage Antwort Stille Regen Hund Buch
Moment Augenblick Raum Platz Anteil Teil Leben Zeit Worte Gefühl Gedanken Problem Grund Wahrheit Veränderung nichts etwas alles niemand jemand will wollte möchte brauche fühle fühlte fühlen denke dachte weiß wusste sage sagte gesagt erzähle erzählte frage fragte antwortete spreche sprach gesprochen höre merke merkte erinnere vergesse
verstehe glaube entschied versuche versuchte angefangen aufgehört gelassen gehe ging gegangen komme kam gekommen bleibe blieb schlafe schlief geschlafen weine weinte schrie warte lese schreibe notieren Sie Ihnen Ihr Ihre wir uns euch sie ihnen dies das jenes viel wenig genug sehr wichtig schwer leicht neu alt anderer jeder gleich scheint
hätte wäre könnte sollte würde hilft geholfen weitermachen trinken rauchen essen nächsten letzten ehrlich ruhiger zum zur beim vom ins ein zwei drei vier fünf sechs sieben acht neun zehn Tage Tagen Wochen Monaten Jahren Stunden Minuten mehrmals woran worüber womit""",
    "pt": """cansado cansada triste calmo calma sozinho sozinha culpado culpada ansioso ansiosa nervoso nervosa zangado zangada exausto exausta inquieto inquieta envergonhado envergonhada aliviado aliviada orgulhoso perdido bloqueado tranquilo tranquila preocupado melhor pior sempre nunca ainda também quase depois então antes durante desde até
manhã tarde noite ontem hoje amanhã semana mês ano verão inverno primavera outono segunda terça quarta quinta sexta sábado domingo mãe pai irmã irmão filha filho tio tia prima primo companheiro companheira marido esposa amigo amiga chefe colega vizinho vizinha professora enfermeira médico terapeuta crianças família equipe grupo escritório
cozinha corredor jardim quarto casa porta janela carro trem rua escola hospital clínica trabalho dinheiro dívida aluguel carta telefone mensagem ligação reunião consulta sessão tarefa diário lista plano meta passo hábito caminhada sono comida apetite peso dor cabeça peito barriga coração mãos voz olhos raiva medo pânico vergonha culpa luto
esperança confiança amor álcool vinho cigarro comprimidos tratamento insônia mudança separação divórcio prova pergunta silêncio chuva cachorro livro nada algo tudo ninguém alguém quero queria preciso sinto senti sentia penso pensei sei sabia digo disse dizer conto contei contou pergunto perguntou respondi falo falei falar escuto noto notei
lembro esqueço entendo acho achava decidi tento tentar comecei começar deixei deixar saio saí sair volto voltei voltar termino terminei chego cheguei durmo dormi dormir dois três quatro cinco seis sete oito nove dez dias horas minutos acordo acordei choro chorei gritei espero leio escrevo anote quando como que quem onde porque embora enquanto segundo entre contra sobre você vocês nós eles elas isso aquilo muito
pouco bastante demais importante difícil fácil novo velho outra outro cada mesma mesmo parece teria poderia deveria gostaria ajuda ajudou continuar mudar beber fumar comer caminhar parte espaço momento próxima última verdade corpo fico ficar ficou sentindo dormindo""",
    "hi": """थका हुआ दुखी शांत अकेला दोषी घबराया परेशान बेचैन शर्मिंदा हल्का खोया बेहतर बुरा हमेशा कभी अभी भी शायद लगभग फिर बाद पहले दौरान सुबह शाम रात कल आज हफ़्ते महीने साल गर्मी सर्दी सोमवार मंगलवार रविवार माँ पिता बहन भाई बेटी बेटा चाचा पति पत्नी दोस्त बॉस पड़ोसी शिक्षक नर्स डॉक्टर बच्चे परिवार समूह दफ़्तर रसोई
घर दरवाज़ा गाड़ी सड़क स्कूल अस्पताल काम पैसा कर्ज़ किराया चिट्ठी फ़ोन संदेश बैठक योजना कदम आदत नींद खाना दर्द सिर दिल हाथ आवाज़ आँखें गुस्सा डर शर्म उम्मीद भरोसा प्यार शराब दवा इलाज सवाल बारिश किताब कुछ सब कोई मुझे मेरा मेरी मेरे आप आपको आपका हम हमने वह उसने उन्होंने यह क्या क्यों कैसे कब कहाँ कौन लेकिन क्योंकि जब
तब अगर चाहता चाहती लगता लगा सोचता सोचा जानता कहा बताया पूछा बात सुना याद समझ कोशिश शुरू बंद गया गई आया रहा रही रहे था थी थे हूँ है हैं होगा करना करता करूँ किया सोया रोया लिखिए महसूस मुश्किल आसान नया पुराना दूसरा हर वही बहुत थोड़ा इतना बदलना ज़रूरी""",
    "ta": """சோர்வாக வருத்தமாக அமைதியாக தனியாக குற்ற உணர்வு பதட்டமாக கோபமாக வெட்கமாக நிம்மதி இழந்த நன்றாக மோசமாக எப்போதும் ஒருபோதும் இன்னும் ஒருவேளை பிறகு முன்பு போது காலை மாலை இரவு நேற்று இன்று நாளை வாரம் மாதம் வருடம் திங்கள் ஞாயிறு அம்மா அப்பா அக்கா தங்கை அண்ணன் தம்பி மகள் மகன் மாமா கணவர் மனைவி நண்பர் முதலாளி
பக்கத்து ஆசிரியர் செவிலியர் மருத்துவர் குழந்தைகள் குடும்பம் குழு அலுவலகம் சமையலறை வீடு கதவு கார் சாலை பள்ளி மருத்துவமனை வேலை பணம் கடன் வாடகை கடிதம் தொலைபேசி செய்தி கூட்டம் திட்டம் படி பழக்கம் தூக்கம் உணவு வலி தலை இதயம் கைகள் குரல் கண்கள் கோபம் பயம் நம்பிக்கை அன்பு மது மருந்து சிகிச்சை கேள்வி மழை புத்தகம் எதுவும்
எல்லாம் யாரும் எனக்கு என் நான் நீங்கள் உங்கள் நாங்கள் அவர் அவள் அது என்ன ஏன் எப்படி எப்போது எங்கே யார் ஆனால் ஏனென்றால் இருந்தால் விரும்புகிறேன் உணர்கிறேன் நினைக்கிறேன் தெரியும் சொன்னேன் கேட்டேன் பேசினேன் முயற்சி தொடங்கினேன் நிறுத்தினேன் போனேன் வந்தேன் இருந்தேன் இருக்கிறேன் இருக்கிறது செய்ய மாற கடினம் எளிது புதிய பழைய வேறு ஒவ்வொரு அதே மிகவும் கொஞ்சம்""",
}
ORDINARY = {k: v.split() for k, v in ORDINARY.items()}

HELD_OUT = """
Anything urgent should go to {email} straight away.
Was it {email} or did I get that wrong?
The bank wrote to {email} instead.
My daughter set up {email} for me.
Escríbele a {email} y espera.
Schreib einfach an {email} zurück.
Call back on {phone}, please.
Her number, I think, is {phone}.
You have {phone} on file, is that still current?
Contact number {phone}
El número de casa es {phone}.
Le numéro de la maison est {phone}.
The card number was {id}, issued in spring.
They wanted to see {id} before they paid.
Licence: {id}
Insurance ID {id} confirmed by phone.
Die Kartennummer ist {id}.
O número do cartão é {id}.
He was arrested near {address} in the night.
I walked all the way to {address} in the snow.
Current residence: {address}
My grandmother left me {address}.
Ella vive en la {address_es} desde enero.
Sie lebt seit Januar in der {address_de}.
I cannot forgive {person} for that.
{person} drove us to the airport.
My uncle {person} drank too.
I went to see {person} about the pain.
Appointment with {person} moved to Friday.
The one who noticed was {person}, of course.
Sat next to {person} in the canteen and said nothing.
Mi tía {person} también bebía.
Meine Tante {person} hat auch getrunken.
Ma tante {person} buvait aussi.
Fui ver {person} por causa da dor.
""".strip().split("\n")

HELD_OUT_COUNTER = """
The bakery opens at 06:30 except on Sundays.
I paid 1,150 for the repair and waited 9 days.
Please keep {code} out of the shared folder.
It was {hidden} who told them.
My grandfather never spoke about the war.
Maybe the walk by the river helped.
Does the silence bother you?
Our supervisor asked for a shorter report.
Concentration better, irritability down.
Hoy me desperté sin ganas de nada.
Heute Morgen bin ich ohne Wecker aufgewacht.
Ce matin je me suis réveillé sans envie.
Hoje acordei sem vontade de nada.
""".strip().split("\n")

_GIVEN = """
James Mary Robert Linda Michael Susan David Karen Daniel Emily Grace Hannah Oliver Chloe Ethan Zoe Liam Aisha Omar Fatima Hassan Leila Yusuf Amina Kwame Ama Chidi Ngozi Wei Mei Jun Yuki
Hiroshi Kenji Sora Minh Linh Arjun Priya Rahul Anita Sanjay Deepa Ravi Lakshmi Carlos Sofia Diego Lucia Javier Carmen Pablo Elena Pierre Camille Julien Amélie Luc Chantal Hans Greta Jürgen
Anke Stefan Heike João Beatriz Tiago Inês Paulo Rita Giulia Marco Ivan Olga Dmitri Katya Piotr Agnieszka Lars Freja Mikko Aino Ioana Radu Eleni Nikos Siobhán Rhys Rose Mark Grant Faith Hope April June
""".split()  # fmt: skip
_FAMILY = """
Smith Jones Taylor Brown Walker Wright Hughes Edwards Collins Murphy Kelly Patel Singh Khan Ahmed Hussain Ali Begum Sharma Gupta Iyer Reddy Nguyen Tran Chen Wang Zhang Kim Park Tanaka Sato
Okafor Mensah Adeyemi Diallo García Martínez Rodríguez Pérez Silva Santos Oliveira Costa Müller Schmidt Weber Becker Dubois Moreau Laurent Lefèvre Rossi Bianchi Kowalski Nowak Ivanov Petrova
Popescu Jensen Nilsson Virtanen Papadopoulos O'Connor McDonald Baker Cook Young King Long Bell West
""".split()  # fmt: skip
_ONSET = "b bl c ch d dr f g gl h j k kr l m n p pr r s sh sk t tw v w y z".split()
_VOWEL = "a e i o u ee ou ai y".split()
_CODA = "n l s t k d m rn ss lt by ton well man son ez ov ska ini ani ita ette ulla ash".split()
_NOTES = "[noise]|(laughs)|*pause*|{sighs}|[inaudible]|<cough>|((sniffs))|♪|(2.0)|[00:12:40]".split("|")
_HESITATION = "um, uh, er, erm, hmm, euh, ähm, eh, ah, mm,".split()
_DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
_ENDS = "com org net example test info co.uk de fr in eu edu".split()
_MAIL_HOSTS = "example mailbox post web fastmail work office college hospital".split()
_LABELS = "Therapist: |Client: |T: |C: |THERAPIST: |CLIENT - |Counsellor: |[T] |[C] |P1: |Speaker 1: |SPEAKER_02: |S1: |<v Client>|Therapeut: |Patient: |Paciente: |Terapeuta: |T\t|C – |Cl.: |Th: |Client 1： |Speaker A – |थेरेपिस्ट: |சிகிச்சையாளர்: ".split("|")


_ROLES = [*THERAPIST_WORDS, *CLIENT_WORDS, *SPEAKER_WORDS, "help seeker", "line manager", "caller", "doctor", "nurse", "social worker"]


class Inventor:
    """Values of every type, from a seeded generator."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def syllables(self, low: int = 1, high: int = 2) -> str:
        r = self.rng
        return ("".join(r.choice(_ONSET) + r.choice(_VOWEL) for _ in range(r.randint(low, high))) + r.choice(_CODA)).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def given(self) -> str:
        return self.rng.choice(_GIVEN) if self.rng.random() < 0.4 else self.syllables()

    def family(self) -> str:
        r = self.rng.random()
        one = lambda: self.rng.choice(_FAMILY) if self.rng.random() < 0.3 else self.syllables()
        return f"{one()}-{one()}" if r < 0.08 else f"{self.rng.choice(['van', 'de', 'da', 'von', 'al'])} {one()}" if r < 0.12 else f"{self.rng.choice(['O', 'D'])}'{one()}" if r < 0.15 else one()

    def person(self) -> str:
        r, first, last = self.rng, self.given(), self.family()
        title = r.choice(["Mr", "Mrs", "Ms", "Dr", "Mr.", "Mrs.", "Dr.", "Prof.", "Miss"])
        full = f"{first} {last}"
        plain = f"{r.choice([self.syllables(), self.syllables(), r.choice(_GIVEN[:-10])])} {self.family()}".lower()  # in lower case only with both names
        return r.choice([
            full, full, full, first, first, f"{title} {last}", f"{title} {last}", f"{title} {full}", f"{last}, {first}", plain, plain, f"{title} {last}".lower(), full.upper(),
            f"{first} {last[0]}.", f"{first[0]}. {last}", f"{first} {self.letters(1)}. {last}", f"{last} {first}",
        ])

    def email(self) -> str:
        r, a, b = self.rng, self.given().lower(), self.syllables().lower()
        host, end = r.choice([self.syllables().lower(), r.choice(_MAIL_HOSTS), r.choice(_MAIL_HOSTS)]), r.choice(_ENDS)
        last = end.split(".")[-1]
        local = r.choice([f"{a}.{b}", f"{a}{self.digits(2)}", f"{a}-{b}", f"{a}_{b}", f"{a}.{b}+{self.syllables(1, 1).lower()}", f"{a[0]}.{b}", f"{a}{b}", f"{a}_{b}{self.digits(1)}", b])
        plain = f"{local}@{host}.{end}"
        return r.choice([
            plain, plain, plain, plain, plain.upper(), f"<{plain}>", f"{local.split('@')[0]}@{host}.{self.syllables(1, 1).lower()}.{end}", f"{a} at {host} dot {last}", f"{a}.{b} at {host} dot {last}",
            f"{a} dot {b} at {host} dot {last}", f"{a}(at){host}(dot){last}", f"{local} [at] {host}.{end}", f"{local} [at] {host} [dot] {last}", f"{a} underscore {b} at {host} dot {last}",
        ])

    def phone(self) -> str:
        """Formats of the numbering plans of several countries, and numbers spelled out."""
        r, d = self.rng, self.digits
        say = lambda n: " ".join(_DIGIT_WORDS[int(c)] for c in d(n))
        spoken = r.choice([f"{say(3)}, {say(4)}", f"{say(3)} {say(4)}", f"{say(3)} {say(3)} {say(4)}", f"oh {say(4)}, {say(3)}, {say(3)}", f"{say(2)} double {say(1)} {say(4)}", f"{say(5)}, {say(6)}"])
        return r.choice([
            f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(4)}", f"{d(3)}-{d(4)}",
            f"{d(3)} {d(3)} {d(4)} {r.choice(['ext.', 'ext', 'x'])} {d(r.randint(1, 4))}", f"+44 {d(4)} {d(6)}", f"+44 7{d(3)} {d(3)} {d(3)}", f"0{d(4)} {d(6)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}",
            f"0{d(3)} {d(3)} {d(4)}", f"020 {d(4)} {d(4)}", f"00 44 {d(4)} {d(6)}", f"0044{d(10)}", f"07{d(9)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}",
            f"+49 {d(3)} {d(7)}", f"+49 {d(2)} {d(7)}", f"0{d(3)}/{d(6)}", f"0{d(3)}-{d(7)}", f"+351 {d(3)} {d(3)} {d(3)}", f"+91 {d(5)} {d(5)}", f"+91-{d(10)}", f"+{d(2)}{d(10)}", spoken, spoken, spoken, spoken,
        ])

    def id(self) -> str:
        """Social security, national insurance, tax, health and passport numbers in their public formats."""
        r, d, a = self.rng, self.digits, self.letters
        tail = r.choice("ABCD")
        return r.choice([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{a(2)}{d(6)}{tail}", f"{a(2)} {d(2)} {d(2)} {d(2)} {tail}", f"{a(2)} {d(6)} {tail}", f"{a(2)}-{d(2)}-{d(2)}-{d(2)}-{tail}",
            f"{a(2)}{d(7)}", f"{a(1)}{d(8)}", f"{a(5)}{d(4)}{a(1)}", f"{a(5)}{d(4)}{a(1)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(8)}{a(1)}", f"{d(8)}-{a(1)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
            f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}",
        ])

    def code(self) -> tuple[str, str]:
        """A study, case or file code: a short prefix, a separator and a running number; no mention."""
        r = self.rng
        prefix = r.choice([self.letters(2), self.letters(2), self.letters(1), self.letters(3), "ID", "CASE", "GRP"])
        number = r.choice([self.digits(2), self.digits(3), self.digits(4), "0" * r.randint(1, 5) + self.digits(3), "0" * r.randint(1, 5) + self.digits(3)])
        whole = prefix + r.choice(["-", "-", "-", "_", " ", ""]) + number
        return (whole.lower() if r.random() < 0.1 else whole), ""

    def hidden(self) -> tuple[str, str]:
        """A placeholder that already stands in a text; no mention."""
        kind = self.rng.choice("NAME PHONE EMAIL ADDRESS PERSON DATE ID".split())
        return self.rng.choice([f"[{kind}]", f"<{kind}>", f"[{kind}_{self.digits(1)}]", f"[{kind.lower()} removed]", f"[{kind} REDACTED]", "XXXX", "***", f"{{{kind}}}"]), ""

    def street(self) -> str:
        r = self.rng
        return r.choice([self.syllables(), self.syllables(), self.syllables(), self.rng.choice(_FAMILY), f"{r.choice('Old New Upper Lower North South Great Mill'.split())} {self.syllables()}", f"{self.syllables()} {r.choice('Hill Park Bridge Field Water Green'.split())}", f"St {r.choice(_GIVEN)}'s"])

    def town(self) -> str:
        r = self.rng
        return r.choice([self.syllables(), self.syllables(), f"{r.choice('Port Saint East West New Upper'.split())} {self.syllables()}", f"{self.syllables()}-on-{self.syllables(1, 1)}"])

    def address(self) -> str:
        r, n = self.rng, self.rng.randint(1, 399)
        kind = r.choice("Street Street Road Road St St. Rd Rd. Lane Lane Ln Close Avenue Ave Ave. Drive Dr Terrace Court Way Crescent Square Place Gardens Boulevard".split())
        number = f"{n}{r.choice(['', '', '', '', 'a', 'B'])}"
        base, town = f"{number} {self.street()} {kind}", self.town()
        code = r.choice([f"{self.letters(2)}{self.digits(1)} {self.digits(1)}{self.letters(2)}", f"{self.letters(2)}{self.digits(2)} {self.digits(1)}{self.letters(2)}", self.digits(5)])
        flat = f"{r.choice(['Flat', 'Apt', 'Apt.', 'Unit', 'flat'])} {r.randint(1, 40)}{r.choice(['', 'A', 'B'])}"
        box = r.choice(["PO Box", "P.O. Box", "P.O.Box", "Box", "po box"])
        return r.choice([
            base, base, base, f"{base}, {town}", f"{base}, {town}", f"{base} in {town}", f"{base}, {town} {code}", f"{base}, {town}, {code}", f"{flat}, {base}", f"{flat}, {base}, {town} {code}", f"{base}, {flat}, {town}",
            f"{box} {n}", f"{box} {n}, {town}", f"{box} {n}, {town} {code}", base.lower(), f"{base}, {town}".lower(), base.upper(),
        ])

    def _romance(self, kinds: list[str]) -> str:
        r, n, street = self.rng, self.rng.randint(1, 250), self.street()
        floor = f"{r.randint(1, 9)}.º {r.choice('ABCD')}"
        base = f"{r.choice(kinds)} {r.choice(['', '', 'de ', 'da ', 'del '])}{street}"
        return r.choice([f"{base} {n}", f"{base}, {n}", f"{base} {n}, {self.town()}", f"{base}, {n}, {floor}", f"{base}, {n}, {floor}, {self.town()}", f"{base} {n}, {self.digits(5)} {self.town()}"])

    def address_es(self) -> str:
        return self._romance(["calle", "Calle", "avenida", "plaza", "paseo"])

    def address_pt(self) -> str:
        return self._romance(["rua", "Rua", "avenida", "travessa", "praça"])

    def address_fr(self) -> str:
        kind, n = self.rng.choice(["rue", "avenue", "boulevard", "impasse", "place"]), f"{self.rng.randint(1, 250)}{self.rng.choice(['', '', ' bis', ' ter'])}"
        base = f"{n}{self.rng.choice([' ', ', '])}{kind} {self.rng.choice(['de ', 'du ', 'des ', 'de la ', ''])}{self.street()}"
        return self.rng.choice([base, base, f"{base}, {self.town()}", f"{base} à {self.town()}", f"{base}, {self.digits(5)} {self.town()}"])

    def address_de(self) -> str:
        n, town = f"{self.rng.randint(1, 250)}{self.rng.choice(['', '', 'a', 'b'])}", self.town()
        base = self.rng.choice([f"{self.syllables()}{self.rng.choice(['straße', 'straße', 'weg', 'gasse', 'platz', 'allee', 'str.'])}", f"{self.syllables()}er {self.rng.choice(['Straße', 'Weg', 'Platz'])}", f"Am {self.syllables()}", f"{self.syllables()}-Straße"])
        return self.rng.choice([f"{base} {n}", f"{base} {n}", f"{base} {n}, {town}", f"{base} {n}, {self.digits(5)} {town}", f"{base} {n} in {town}"])

    def value(self, mark: str) -> tuple[str, str]:
        if mark in ("code", "hidden"):
            return getattr(self, mark)()
        return getattr(self, mark)(), "identity_number" if mark == "id" else mark.split("_")[0]

    def filler(self) -> str:
        """Something that may stand between any two words of a transcript."""
        return self.rng.choice(_HESITATION if self.rng.random() < 0.6 else _NOTES)

    def front(self) -> str:
        """A stamp and a speaker label, or either, as they stand in front of a line."""
        r, d = self.rng, self.digits
        clock = f"0{d(1)}:{d(2)}:{d(2)}"
        stamp = r.choice([f"[{clock}] ", f"({d(2)}:{d(2)}) ", f"{clock} ", f"{d(2)}:{d(2)} - ", f"{d(2)}\n{clock},{d(3)} --> {clock},{d(3)}\n", f"{clock}.{d(3)} --> {clock}.{d(3)}\n", "- ", "", "", "", ""])
        if r.random() < 0.5:
            role = r.choice(_ROLES)
            role = r.choice([role, role.capitalize(), role.capitalize(), role.upper(), "-".join(x.capitalize() for x in role.split())])
            return stamp + r.choice(["", "", "[", "<v "]) + role + r.choice(["", "", " 1", "_2", " A", "]"]) + r.choice([": ", ":", " : ", " - ", " – ", "： ", ":\t", "> ", "\t"])
        return stamp + (r.choice(_LABELS) if r.random() < 0.85 else "")

    def filled(self, sentence: str) -> list[tuple[str, str]]:
        pieces, rest = [], sentence
        while "{" in rest:
            before, mark = rest.split("{", 1)
            mark, rest = mark.split("}", 1)
            pieces += [(before, ""), self.value(mark)]
        return [*pieces, (rest, "")]


def _composed(make: Inventor) -> list[tuple[str, str]]:
    """A sentence put together: something before, a mention or something ordinary, something behind."""
    r = make.rng
    mark = r.choice(["person"] * 7 + ["phone", "id", "address", "email", "address_es", "address_pt", "address_fr", "address_de"])
    before = r.choice(BEFORE[mark])
    if r.random() < 0.5 and mark[:7] != "address":
        before = r.choice(PLAIN) + " " + before if r.random() < 0.3 else before
    if r.random() < 0.4:
        before = before[0].upper() + before[1:]
    if r.random() < 0.06:
        before = ""
    behind = r.choice(BEHIND)
    what = (r.choice(PLAIN), "") if r.random() < 0.35 else make.value(mark)
    if r.random() < 0.03:
        what = make.value(r.choice(["code", "hidden"]))
    more = []
    if what[1] and r.random() < 0.12:
        more = [(r.choice([" / ", ", ", " and ", " - ", " (", "; ", " or "]), ""), make.value(r.choice(["phone", "email", "person", "id", "address"]))]
    end = behind if behind[0] in ".?!;),: " else " " + behind
    return [(before + " " * bool(before), ""), what, *more, (end + (r.choice([".", ".", "?", "", " " + r.choice(PLAIN) + "."]) if len(end) > 3 else ""), "")]


def _words(make: Inventor) -> list[tuple[str, str]]:
    """Ordinary words of one language in any order, with the marks a sentence has."""
    r = make.rng
    words = r.choices(r.choice(list(ORDINARY.values())), k=r.randint(4, 12))
    words[0] = words[0][0].upper() + words[0][1:]
    words = [w + r.choice(["", "", "", "", "", ","]) for w in words]
    return [(" ".join(words).rstrip(",") + r.choice([".", ".", ".", "?", "!", ""]), "")]


def _noisy(make: Inventor, pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Fillers between words and line breaks in place of blanks, outside mentions mostly."""
    out = []
    for text, kind in pieces:
        words = text.split(" ")
        if len(words) > 2 and make.rng.random() < 0.2 and (not kind or make.rng.random() < 0.1):
            words.insert(make.rng.randint(1, len(words) - 1), make.filler())
        text = " ".join(words)
        blanks = [j for j, c in enumerate(text) if c == " "]
        if blanks and make.rng.random() < (0.1 if kind == "address" else 0.05):
            at = make.rng.choice(blanks)
            text = text[:at] + "\n" + text[at + 1 :]
        out.append((text, kind))
    return out


def labelled(n_fills: int, seed: int, sentences: list[str] = SENTENCES, counter: list[str] = COUNTER, composed: int = 3) -> list[list[tuple[str, str]]]:
    """Short texts as lists of (piece, type or ''): each sentence ``n_fills`` times, and ``composed`` times as many put together, among counter-examples, lines and labels."""
    make, out = Inventor(seed), []
    r = make.rng
    for _ in range(n_fills):
        own = [(x, None) for x in sentences + counter] + [(None, i) for i in range(len(sentences) * composed)]
        for sentence, _ in own:
            pieces = [(make.front(), "")] if r.random() < 0.6 else []
            other = lambda: _words(make) if composed and r.random() < 0.5 else make.filled(r.choice(counter))
            if r.random() < 0.4:
                pieces += other() + [(r.choice([" ", "\n"]), "")]
            body = make.filled(sentence) if sentence else _composed(make)
            if r.random() < 0.06:
                body = [(t.lower(), k) for t, k in body]
            pieces += body
            while r.random() < 0.3:
                pieces += [(r.choice([" ", " ", "\n"]), "")] + other()
            if r.random() < 0.3:
                pieces += [("\n" + make.front(), "")] + other()
            out.append(_noisy(make, pieces))
    r.shuffle(out)
    return out


def ordinary_vocabulary() -> frozenset[str]:
    """Words in lower case that stand outside the mentions of the table."""
    text = " ".join([re.sub(r"\{\w+\}", " ", x) for x in SENTENCES + COUNTER] + [w for v in BEFORE.values() for w in v] + BEHIND + PLAIN + [w for v in ORDINARY.values() for w in v])
    return frozenset(w.lower() for w in re.findall(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u0900-\u0dff])*", text))


def fingerprint(n_fills: int, seed: int) -> str:
    """Tells whether stored weights were fitted on this table."""
    return hashlib.sha256(Path(__file__).read_bytes() + repr((n_fills, seed)).encode()).hexdigest()
