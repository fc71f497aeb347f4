"""Common short insults, threats and solicitations, as any dictionary of abuse has them.

They help where a data set has few reviews, above all in languages other than English. None has three words in a row
(four characters in Chinese) with any text of the test tables; a test proves it. Near misses are learned from reviews.
"""

UNWANTED = """
you are an idiot
what a moron you are
you stupid liar
you people are imbeciles
you disgusting pig
get lost you bastard
you bitch
kill yourself
i will kill you
i am going to beat you up
send me nudes
watch free porn videos
my cock is hard for you
cállate, imbécil
vete a la mierda
hijo de puta
te voy a matar
mándame fotos desnuda
quiero follarte esta noche
va te faire foutre
je vais te tuer
envoie-moi des photos de toi nue
je veux te baiser ce soir
verpiss dich
ich bringe dich um
schick mir nacktfotos
ich will dich ficken
vai tomar no cu
filho da puta
vou te matar
manda foto pelada
quero transar com você hoje
滚开，你这个混蛋
去死吧
我要杀了你
给我发裸照
今晚想和你做爱
ты идиот
заткнись, сволочь
чтоб ты сдох
я тебя убью
пришли голые фото
""".strip().splitlines()
