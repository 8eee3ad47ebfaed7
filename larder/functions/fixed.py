"""Word lists, lookup tables and patterns that results depend on, in their natural order.

Tables of texts are plain text, a line per entry, ``key = value`` where an entry has a value; tables of numbers are literals.
The order matters wherever the first entry that fits decides.
"""

from __future__ import annotations

def _lines(text: str) -> list[str]:
    return [line for line in text.strip("\n").split("\n") if line]


def _pairs(text: str) -> dict[str, str]:
    return dict(line.split(" = ", 1) for line in _lines(text))


# ---- Fixed values ----

FOOD_KEYWORDS = _pairs(r"""
banana = Produce
apple = Produce
avocado = Produce
strawberries = Produce
blueberries = Produce
spinach = Produce
broccoli = Produce
tomato = Produce
onion = Produce
potato = Produce
carrot = Produce
bell pepper = Produce
orange = Produce
lettuce = Produce
mushrooms = Produce
cucumber = Produce
asparagus = Produce
celery = Produce
sweet potato = Produce
mixed greens = Produce
corn = Produce
zucchini = Produce
peach = Produce
pear = Produce
kiwi = Produce
cauliflower = Produce
watermelon = Produce
mango = Produce
pineapple = Produce
lemon = Produce
lime = Produce
grapes = Produce
cherries = Produce
peas = Produce
cabbage = Produce
eggplant = Produce
green beans = Produce
radish = Produce
beet = Produce
milk = Dairy
egg = Dairy
cheese = Dairy
yogurt = Dairy
butter = Dairy
sour cream = Dairy
heavy cream = Dairy
cream cheese = Dairy
chicken breast = Meat
chicken thigh = Meat
ground beef = Meat
ground turkey = Meat
salmon = Meat
shrimp = Meat
tuna = Meat
tilapia = Meat
bacon = Meat
ham = Meat
beef steak = Meat
pork chop = Meat
sausage = Meat
bread = Grains
rice = Grains
pasta = Grains
oats = Grains
flour = Grains
tortilla = Grains
bagel = Grains
english muffin = Grains
potato chips plain salted = Snacks
corn tortilla chips = Snacks
cookies chocolate chip = Snacks
cookies chocolate sandwich = Snacks
ice cream premium = Snacks
ice cream regular = Snacks
crackers saltine = Snacks
crackers whole wheat = Snacks
juice = Beverages
water = Beverages
coffee = Beverages
tea = Beverages
carbonated cola beverage = Beverages
sports drink = Beverages
energy drink = Beverages
""")

FOOD_CATEGORIES = _lines(r"""
Beverages
Dairy
Grains
Meat
Produce
Snacks
""")

ABBREVIATIONS = _pairs(r"""
WFM = Whole Foods Market
TJ = Trader Joe's
GV = Great Value
KS = Kirkland Signature
365 = 365
ORG = Organic
OG = Organic
ORGN = Organic
CF = Cage Free
CGFR = Cage Free
NHP = NHP
FZN = Frozen
FRZ = Frozen
FROZ = Frozen
BRDD = Breaded
SLCD = Sliced
SHRDD = Shredded
SHRD = Shredded
RSTD = Roasted
RSTED = Roasted
RO = Roasted
GRLD = Grilled
SMK = Smoked
SMKD = Smoked
CHPD = Chopped
UNSWT = Unsweetened
RDC = Reduced
RDCD = Reduced
CHKN = Chicken
CHCKN = Chicken
BRST = Breast
BNLS = Boneless
SKNLS = Skinless
TNDRL = Tenderloin
FLLT = Fillet
FLLTS = Fillets
BF = Beef
PRK = Pork
TRKY = Turkey
SLMN = Salmon
SHRMP = Shrimp
GRN = Green
BNS = Beans
BLK = Black
VEG = Vegetable
VEGG = Veggie
SWT = Sweet
PTT = Potato
POTA = Potato
PTO = Potato
TMT = Tomato
TOMA = Tomato
MUSH = Mushroom
MSHRM = Mushroom
BRCL = Broccoli
BROC = Broccoli
SPNCH = Spinach
CUKE = Cucumber
CUCS = Cucumbers
LTT = Lettuce
CRRT = Carrot
ONI = Onion
PEP = Pepper
PPRS = Peppers
GRLC = Garlic
STRW = Strawberry
STRWB = Strawberries
BLUBR = Blueberry
BLUEB = Blueberries
BANA = Banana
APPL = Apple
MNG = Mango
MNGO = Mango
AVCD = Avocado
LMN = Lemon
ORNG = Orange
MLK = Milk
CTTG = Cottage
CTGE = Cottage
CHDR = Cheddar
MOZZ = Mozzarella
PARM = Parmesan
YGT = Yogurt
YGRT = Yogurt
CRM = Cream
BTR = Butter
CHEE = Cheese
CHS = Cheese
CHSE = Cheese
WHT = White
WHIT = White
WHL = Whole
HLF = Half
GAL = Gallon
QRT = Quart
HG = Half Gallon
LF = Low Fat
LWFT = Low Fat
FF = Fat Free
OGLF = Organic Low Fat
OGLWF = Organic Low Fat
TORTL = Tortilla
TORT = Tortellini
PL = Plant
PLT = Plant
PLNT = Plant
RAV = Ravioli
ARUG = Arugula
ITAL = Italian
ROOLS = Rolls
PAR = Par
SW = Southwest
SLD = Salad
FLVR = Flavor
VAN = Vanilla
VNLA = Vanilla
CHOC = Chocolate
DK = Dark
PB = Peanut Butter
HNY = Honey
CINN = Cinnamon
SLT = Salt
LS = Low Sodium
EVOO = Extra Virgin Olive Oil
OO = Olive Oil
PCK = Pack
PK = Pack
CTN = Carton
BTL = Bottle
BG = Bag
BX = Box
EA = Each
DZ = Dozen
LG = Large
SM = Small
MED = Medium
REG = Regular
CV = Conventional
FRT = Fruit
FRSH = Fresh
BBY = Baby
BLLA = Bella
OV = Oven
STRAW = Straw
BERIES = Berries
REC = Recommended
MP = Market Pantry
GG = Good & Gather
FRTSN = Fruit Snacks
ENER = Energy
MASTERPC = Masterpiece
SDNLY = Suddenly
CUISIN = Cuisine
AQUAF = Aquafina
SUBB = Sub Sandwich
REDDI = Reddi
WIP = Wip
PANT = Pantry
NATVAL = Nature Valley
ATAULFO = Ataulfo Mango
MM = Member's Mark
MEDL = Medley
SWAI = Swai
KRO = Kroger
HLAM = Hoffman's American
MLLR = Miller
ALPRS = Alps
BRDV = Birds Eye Voila
TRSME = TRESemmé
DSCH = Deschutes
KOSH = Kosher
TMTE = Tomato
SNDWCH = Sandwich
PLNTR = Planter
MSTRPC = Masterpiece
SCE = Sauce
MDJL = Medjool
PTD = Pitted
BNTY = Bounty
GRANU = Granulated
BANAN = Banana
HEB = H-E-B
CHP = Chip
THNS = Thins
""")

MISSPELLINGS = _pairs(r"""
STRAWBERIES = STRAWBERRIES
STRWBERRIES = STRAWBERRIES
BLUBERRIES = BLUEBERRIES
RASBERRIES = RASPBERRIES
BROCOLI = BROCCOLI
TORTILA = TORTILLA
CHOCLATE = CHOCOLATE
YOGRT = YOGURT
MOZZARELA = MOZZARELLA
PARMESN = PARMESAN
""")

KEPT_UPPER = _lines(r"""
NHP
OZ
LB
KG
ML
EA
DZ
FUJI
""")

NOISE_WORDS = _lines(r"""
COUPON
DISCOUNT
SAVINGS
PROMO
REWARD
MEMBER
SUBTOTAL
TOTAL
TAX
CHANGE
CASH
CREDIT
DEBIT
BALANCE
AMOUNT
DUE
ROUNDING
TIP
GRATUITY
TARE
ITEM
BAL
BAG FEE
FEE
INVOICE
RECEIPT
SIGNATURE
AUTHORIZED
""")

NOISE_PATTERNS = _lines(r"""
(?i)^Cartwheel\b
(?i)^Target Circle
(?i)^Buy\d+Get
(?i)^Your REDcard\b
(?i)^PACKAGE\s+(SUBTOTAL|TOTAL)\b
(?i)^Regular Price\b
(?i)^RegPrice\b
(?i)CardSav\b
(?i)^Refund Value\b
(?i)^Saved\b.*\boff\b
(?i)^You Saved\b
(?i)^Promotion\b
(?i)^Transaction Disc
(?i)^Savings Summary\b
(?i)^Order Total\b
(?i)^Grand Total\b
(?i)^MFR COUPON\b
(?i)^Mfr\.?\s*eCoupon\b
(?i)^Paper Mfr Coupon\b
(?i)^MC\s+SCANNED COUPON\b
(?i)^DIGITAL COUPON\b
(?i)^CATEGORY COUPON\b
(?i)^Bottle Deposit\b
(?i)^SC\s+KROGER\s+SAVINGS\b
(?i)^KROGER PLUS\b
(?i)^SC\s+\w+\s+SAVINGS\b
(?i)^DC\s+\w
(?i)^OUR BRAND SAVINGS\b
(?i)^DIGITAL COUPONS\b
(?i)^YOU SAVED\b
(?i)^\*+\s*Sale Subtotal
(?i)^\*+\s*Total Sale
(?i)^ITEMS PURCHASED\b
(?i)^EFT\s+DEBIT\b
(?i)^PAY FROM\b
(?i)^PRIMARY\b
(?i)^CHANGE DUE\b
(?i)^DEBIT TEND\b
(?i)^CASH TEND\b
(?i)^# ITEMS\b
(?i)^# ITEMS SOLD\b
(?i)^Low Prices You Can
(?i)^OK Member\b
(?i)^APPROVED\b
(?i)^CLUB MANAGER\b
(?i)^MASTERCARD\b
(?i)^TOTAL NUMBER OF ITEMS\b
(?i)^AMOUNT DUE\b
(?i)^\+\+APPROVED
(?i)^Credit Card\s+\$
(?i)^PROMO\b
(?i)^New Bal
^\d{3}-\d{3}-\d{3}-\d{3}
^\*\d{4}\b
(?i)^x{3,}
(?i)^AID\s+A\d+
(?i)^AAC\s+\w+
(?i)^TERMINAL\s+#
(?i)^REF\s+#
(?i)^NETWORK\s+ID
(?i)^Auth\s+#
(?i)^TVR\s+\d
(?i)^IAD\s+\d
(?i)^TSI\s+\w
(?i)^TC#\s+\d
(?i)^Seq#
(?i)^OP#
(?i)^US DEBIT\b
(?i)^VISA\b
(?i)^SOLD\s+\d+
(?i)^Give us feedback
(?i)^survey\.
(?i)^Thank you
(?i)^Please Come\b
(?i)^Your cashier\b
(?i)^Show your\b
(?i)^Date of Birth\b
(?i)^Scan with\b
(?i)^Together,?\s+we
(?i)^Savings at Pub
(?i)INDICATES SAVINGS
(?i)ALL ITEMS MUST BE RETURNED
(?i)TOTAL SAVINGS THIS TRIP
(?i)AID\s*:?\s*A\d{10,}
(?i)RRN\s*:
(?i)Entry Method
(?i)CHIP READ
(?i)CONTACTLESS
(?i)Cntctless
(?i)NO SIGNATURE REQUIRED
(?i)AUTH CODE\s*:
(?i)^AUTH CODE$
(?i)ACCOMPANIED WITH RECEIPT
(?i)^USD\s*\$
(?i)^Issuer$
(?i)ENTRY LEGEND
(?i)^\d{10,}.*RRN
(?i)APPLIED TO THE ORIGINAL ORDER
(?i)YOU.RE SHOPPING SMARTER
(?i)WHEN YOU RETURN ANY ITEM
(?i)RETURN CREDIT WILL NOT
(?i)PROMOTIONAL DISCOUNT OR COUP
(?i)CUENTENOS EN ESPA
(?i)FOR SHOPPING AT
(?i)^TID\s*:
(?i)INVOICE\s*:
(?i)^UWAJIMAYA
(?i)^TRADER JOE.S\s+TRADER
(?i)FAMILY MARKET\s+\d{3}
^[FP\s\$\d.]+$
(?i)^\$\s*\d+\.\d{2}(\s+[FT])?$
(?i)^P\s*\$\s*\d
(?i)^FP\s*\$
(?i)^Qty\s+Description
(?i)^[0-9A-F]{20,}
(?i)^\d{13,}\s+ACCOMPANIED
^[　-鿿가-힯\s/\[\]()]+$
(?i)ALL ALCOHOL SALES
(?i)SEE STORE FOR MORE DETAILS
(?i)NO RETURNS FOR SPECIFIED
(?i)RESTROOM CODE
(?i)THANK YOU FOR SHOPPING
(?i)NOW HIRING
(?i)^STORE TILL$
(?i)^STORE$
(?i)^TILL$
(?i)^WHOLE FOODS MARKET
(?i)^WHOLE FOODS$
^[A-Z0-9]{10,}$
^\d{20,}
(?i)SHOPPING EXPERIENCE
(?i)CHANCE TO WIN
(?i)GIFT CARD
(?i)wfm\.com
(?i)amazon\.com
(?i)Earn.*back at
(?i)Prime Visa
""")

SECTION_HEADERS = _lines(r"""
GROCERY
CLEANING SUPPLIES
HEALTH-BEAUTY-COSMETICS
HEALTH AND BEAUTY
HOME
ELECTRONICS
APPAREL
BABY
PETS
TOYS
SEASONAL
MARKET
SPECIAL PROMOTION
REFRIG/FROZEN
PRODUCE
MISCELLANEOUS
DAIRY
BAKERY
DELI
MEAT
SEAFOOD
FROZEN
BEVERAGES
SNACKS
PHARMACY
""")

NONFOOD_SECTIONS = _lines(r"""
CLEANING SUPPLIES
HEALTH-BEAUTY-COSMETICS
HEALTH AND BEAUTY
HOME
ELECTRONICS
APPAREL
BABY
PETS
TOYS
SEASONAL
MISCELLANEOUS
PHARMACY
""")

HEADER_WORDS = _lines(r"""
WHOLE FOODS
TRADER JOE
WALMART
COSTCO
TARGET
KROGER
SAFEWAY
MARKET
STORE #
OPEN 
DAILY
SHARON
Charlotte
H-E-B
HEB
ALDI
PUBLIX
SAM'S CLUB
SAMS CLUB
WHOLESALE
MEIJER
WINCO
SPROUTS
""")

STORES = _pairs(r"""
WHOLE FOODS = Whole Foods
TRADER JOE = Trader Joe's
WALMART = Walmart
COSTCO = Costco
WHOLESALE = Costco
TARGET = Target
KROGER = Kroger
SAFEWAY = Safeway
ALDI = Aldi
H-E-B = H-E-B
HEB = H-E-B
PUBLIX = Publix
SAM'S CLUB = Sam's Club
SAMS CLUB = Sam's Club
SAM'S = Sam's Club
MEIJER = Meijer
WINCO = WinCo
SPROUTS = Sprouts
H MART = H Mart
HMART = H Mart
UWAJIMAYA = Uwajimaya
T&T SUPERMARKET = T&T Supermarket
T & T SUPERMARKET = T&T Supermarket
T & T = T&T Supermarket
ASIAN FAMILY = Asian Family Market
ASIANFAMILYMKT = Asian Family Market
99 RANCH = 99 Ranch Market
RANCH 99 = 99 Ranch Market
MITSUWA = Mitsuwa
MARUKAI = Marukai
LOTTE = Lotte Plaza
FRED MEYER = Fred Meyer
QFC = QFC
ALBERTSONS = Albertsons
VONS = Vons
RALPHS = Ralphs
WEGMANS = Wegmans
GROCERY OUTLET = Grocery Outlet
TRADER JOE'S = Trader Joe's
""")

# value and unit
DEFAULT_WEIGHTS: dict[str, tuple[float, str]] = {
    "cookie": (6.3, "oz"),
    "cookies": (6.3, "oz"),
    "chip": (4.8, "oz"),
    "chips": (4.8, "oz"),
    "crackers": (5.0, "oz"),
    "cracker": (5.0, "oz"),
    "popcorn": (3.5, "oz"),
    "nuts": (7.1, "oz"),
    "pretzels": (5.0, "oz"),
    "granola bar": (1.8, "oz"),
    "energy bar": (1.8, "oz"),
    "protein bar": (1.8, "oz"),
    "trail mix": (7.1, "oz"),
    "milk": (2.2, "lb"),
    "yogurt": (7.1, "oz"),
    "cheese": (7.1, "oz"),
    "cottage cheese": (7.1, "oz"),
    "cream cheese": (7.8, "oz"),
    "butter": (8.8, "oz"),
    "cream": (8.8, "oz"),
    "sour cream": (8.8, "oz"),
    "ice cream": (14.4, "oz"),
    "bread": (11.6, "oz"),
    "tortilla": (12.6, "oz"),
    "bagels": (12.0, "oz"),
    "bagel": (12.0, "oz"),
    "rolls": (11.6, "oz"),
    "muffins": (7.9, "oz"),
    "croissants": (8.1, "oz"),
    "pita": (8.0, "oz"),
    "buns": (11.6, "oz"),
    "english muffins": (12.0, "oz"),
    "baguette": (10.0, "oz"),
    "cereal": (14.1, "oz"),
    "granola": (14.1, "oz"),
    "oatmeal": (14.1, "oz"),
    "pasta": (16.0, "oz"),
    "rice": (28.2, "oz"),
    "noodles": (8.0, "oz"),
    "flour": (16.0, "oz"),
    "canned": (11.6, "oz"),
    "beans": (15.0, "oz"),
    "canned vegetables": (14.1, "oz"),
    "canned fruit": (15.0, "oz"),
    "canned soup": (15.3, "oz"),
    "canned fish": (5.0, "oz"),
    "soup": (14.8, "oz"),
    "frozen": (14.1, "oz"),
    "frozen vegetables": (21.2, "oz"),
    "frozen fruit": (15.9, "oz"),
    "frozen pizza": (13.8, "oz"),
    "frozen meal": (14.1, "oz"),
    "frozen dessert": (14.6, "oz"),
    "cuisine": (14.1, "oz"),
    "frozen fries": (26.5, "oz"),
    "chicken": (12.5, "oz"),
    "chicken breast": (12.5, "oz"),
    "ground beef": (16.0, "oz"),
    "beef": (10.6, "oz"),
    "pork": (7.1, "oz"),
    "turkey": (10.6, "oz"),
    "turkey breast": (8.0, "oz"),
    "bacon": (6.3, "oz"),
    "sausage": (10.6, "oz"),
    "hot dog": (16.0, "oz"),
    "deli meat": (8.0, "oz"),
    "ham": (8.0, "oz"),
    "salami": (3.5, "oz"),
    "salmon": (12.0, "oz"),
    "tuna": (5.0, "oz"),
    "shrimp": (16.0, "oz"),
    "eggs": (18.0, "oz"),
    "apples": (2.2, "lb"),
    "banana": (27.1, "oz"),
    "orange": (3.3, "lb"),
    "lemon": (17.6, "oz"),
    "avocado": (12.0, "oz"),
    "mango": (10.6, "oz"),
    "strawberries": (15.9, "oz"),
    "blueberries": (10.6, "oz"),
    "berries": (10.6, "oz"),
    "grapes": (17.6, "oz"),
    "tomato": (14.1, "oz"),
    "potato": (2.2, "lb"),
    "onion": (17.6, "oz"),
    "carrot": (17.6, "oz"),
    "lettuce": (15.9, "oz"),
    "broccoli": (17.6, "oz"),
    "spinach": (10.6, "oz"),
    "cucumber": (15.9, "oz"),
    "pepper": (1.8, "oz"),
    "mushroom": (8.8, "oz"),
    "plums": (1.0, "lb"),
    "juice": (2.2, "lb"),
    "orange juice": (2.2, "lb"),
    "apple juice": (2.2, "lb"),
    "soda": (17.6, "oz"),
    "water": (26.5, "oz"),
    "sparkling water": (26.5, "oz"),
    "energy drink": (12.5, "oz"),
    "sports drink": (12.5, "oz"),
    "coffee": (8.8, "oz"),
    "tea": (2.0, "oz"),
    "plant milk": (2.2, "lb"),
    "almond milk": (2.2, "lb"),
    "oat milk": (2.2, "lb"),
    "soy milk": (2.2, "lb"),
    "coconut milk": (2.2, "lb"),
    "ketchup": (17.6, "oz"),
    "mustard": (8.0, "oz"),
    "mayonnaise": (13.2, "oz"),
    "bbq sauce": (13.4, "oz"),
    "hot sauce": (8.6, "oz"),
    "salsa": (8.8, "oz"),
    "pasta sauce": (12.3, "oz"),
    "sauce": (12.3, "oz"),
    "salad dressing": (12.3, "oz"),
    "soy sauce": (8.8, "oz"),
    "vinegar": (17.6, "oz"),
    "oil": (26.5, "oz"),
    "olive oil": (26.5, "oz"),
    "hummus": (7.1, "oz"),
    "peanut butter": (14.5, "oz"),
    "jam": (12.0, "oz"),
    "honey": (16.0, "oz"),
    "syrup": (17.6, "oz"),
    "pickles": (11.3, "oz"),
    "sugar": (17.6, "oz"),
    "chocolate": (6.3, "oz"),
    "chocolate bar": (6.3, "oz"),
    "baking mix": (14.8, "oz"),
    "pizza": (14.1, "oz"),
    "burrito": (9.7, "oz"),
    "ramen": (3.0, "oz"),
    "instant noodles": (3.0, "oz"),
    "tortellini": (8.8, "oz"),
    "ravioli": (10.6, "oz"),
    "waffle": (7.1, "oz"),
    "pancake": (8.8, "oz"),
    "baby food": (8.4, "oz"),
    "hazelnut spread": (12.7, "oz"),
    "chocolate spread": (12.3, "oz"),
    "cashew": (7.1, "oz"),
}

BRANDS = _pairs(r"""
breyers = ice cream
haagen = ice cream
ben & jerry = ice cream
talenti = ice cream
blue bunny = ice cream
reddi wip = cream
cool whip = cream
chobani = yogurt
fage = yogurt
dannon = yogurt
yoplait = yogurt
siggi = yogurt
oikos = yogurt
cheerios = cereal
frosted flakes = cereal
quaker = cereal
coca cola = soda
pepsi = soda
sprite = soda
dr pepper = soda
mountain dew = soda
tropicana = juice
simply = juice
minute maid = juice
doritos = chips
lays = chips
pringles = chips
tostitos = chips
ruffles = chips
fritos = chips
oreo = cookie
chips ahoy = cookie
nutter butter = cookie
ritz = crackers
triscuit = crackers
wheat thins = crackers
goldfish = crackers
cheez-it = crackers
lean cuisine = frozen meal
stouffer = frozen meal
marie callender = frozen meal
healthy choice = frozen meal
evol = frozen meal
amy's = frozen meal
digiorno = frozen pizza
totino = frozen pizza
red baron = frozen pizza
heinz = ketchup
french's = mustard
hellmann = mayonnaise
hidden valley = salad dressing
smucker = jam
welch = jam
jif = peanut butter
skippy = peanut butter
peter pan = peanut butter
oscar mayer = deli meat
jennie-o = turkey
jennie-0 = turkey
tyson = chicken
perdue = chicken
butterball = turkey
hillshire = sausage
jimmy dean = sausage
bird = frozen meal
naked = juice
v8 = juice
aquafina = water
dasani = water
gatorade = sports drink
powerade = sports drink
starbucks = coffee
dunkin = coffee
nature valley = granola bar
kind = granola bar
clif = energy bar
rxbar = protein bar
pepperidge = bread
arnold = bread
sara lee = bread
dave's killer = bread
""")

CONDIMENTS = _lines(r"""
salt
pepper
spice
seasoning
sauce packet
powder
extract
flavor
syrup
vinegar
dressing
""")

MODIFIERS = _lines(r"""
organic
fresh
frozen
natural
whole
raw
unsweetened
roasted
sliced
shredded
chopped
breaded
grilled
smoked
reduced
low
fat
free
each
baby
par
baked
just
""")

GENERIC_WORDS = _lines(r"""
organic
fresh
frozen
natural
whole
raw
just
original
classic
premium
select
best
great
value
bag
box
pack
each
size
large
small
mini
new
old
no
with
and
or
the
in
of
pasta
sauce
salad
bread
milk
juice
water
bar
mix
style
free
less
more
extra
super
""")

SENSITIVE_WORDS = _lines(r"""
dog
cat
pet
baby
infant
puppy
kitten
canine
feline
veterinary
vet
""")

NONFOOD_BRANDS = _lines(r"""
FIGMINT
COLGATE
RAW SUGAR
UP & UP
EQUATE
CLOROX
LYSOL
WINDEX
TIDE
""")

PAYMENT_WORDS = _lines(r"""
AID :
AUTH CODE
MASTERCARD
ENTRY METHOD
CONTACTLESS
CHIP READ
INVOICE :
RRN :
USD $
ACCOMPANIED
ORIGINAL ORDER
SHOPPING SMARTER
CUENTENOS
REUSABLE BAG
SHOPPING BAG
FIGMINT
COLGATE
RAW SUGAR
""")

# energy_kcal fat saturated_fat carbohydrates sugars fiber proteins salt sodium, per 100 g
STAPLES: dict[str, tuple[float, ...]] = {
    "apple": (52, 0.2, 0.0, 13.8, 10.4, 2.4, 0.3, 0.0, 0.001),
    "banana": (89, 0.3, 0.1, 22.8, 12.2, 2.6, 1.1, 0.0, 0.001),
    "orange": (47, 0.1, 0.0, 11.8, 9.4, 2.4, 0.9, 0.0, 0.0),
    "lemon": (29, 0.3, 0.0, 9.3, 2.5, 2.8, 1.1, 0.0, 0.002),
    "mango": (60, 0.4, 0.1, 15.0, 13.7, 1.6, 0.8, 0.0, 0.001),
    "avocado": (160, 14.7, 2.1, 8.5, 0.7, 6.7, 2.0, 0.0, 0.007),
    "strawberr": (32, 0.3, 0.0, 7.7, 4.9, 2.0, 0.7, 0.0, 0.001),
    "blueberr": (57, 0.3, 0.0, 14.5, 10.0, 2.4, 0.7, 0.0, 0.001),
    "blackberr": (43, 0.5, 0.0, 9.6, 4.9, 5.3, 1.4, 0.0, 0.001),
    "raspberr": (52, 0.7, 0.0, 11.9, 4.4, 6.5, 1.2, 0.0, 0.001),
    "grape": (69, 0.2, 0.1, 18.1, 15.5, 0.9, 0.7, 0.0, 0.002),
    "pear": (57, 0.1, 0.0, 15.2, 9.8, 3.1, 0.4, 0.0, 0.001),
    "peach": (39, 0.3, 0.0, 9.5, 8.4, 1.5, 0.9, 0.0, 0.0),
    "plum": (46, 0.3, 0.0, 11.4, 9.9, 1.4, 0.7, 0.0, 0.0),
    "cherry": (50, 0.3, 0.1, 12.2, 8.5, 1.6, 1.0, 0.0, 0.003),
    "watermelon": (30, 0.2, 0.0, 7.6, 6.2, 0.4, 0.6, 0.0, 0.001),
    "cantaloupe": (34, 0.2, 0.1, 8.2, 7.9, 0.9, 0.8, 0.0, 0.016),
    "pineapple": (50, 0.1, 0.0, 13.1, 9.9, 1.4, 0.5, 0.0, 0.001),
    "kiwi": (61, 0.5, 0.0, 14.7, 9.0, 3.0, 1.1, 0.0, 0.003),
    "broccoli": (34, 0.4, 0.0, 6.6, 1.7, 2.6, 2.8, 0.0, 0.033),
    "carrot": (41, 0.2, 0.0, 9.6, 4.7, 2.8, 0.9, 0.0, 0.069),
    "spinach": (23, 0.4, 0.1, 3.6, 0.4, 2.2, 2.9, 0.0, 0.079),
    "lettuce": (15, 0.2, 0.0, 2.9, 1.3, 1.3, 1.4, 0.0, 0.028),
    "tomato": (18, 0.2, 0.0, 3.9, 2.6, 1.2, 0.9, 0.0, 0.005),
    "cucumber": (15, 0.1, 0.0, 3.6, 1.7, 0.5, 0.7, 0.0, 0.002),
    "potato": (77, 0.1, 0.0, 17.5, 0.8, 2.1, 2.0, 0.0, 0.006),
    "sweet potato": (86, 0.1, 0.0, 20.1, 4.2, 3.0, 1.6, 0.0, 0.055),
    "onion": (40, 0.1, 0.0, 9.3, 4.2, 1.7, 1.1, 0.0, 0.004),
    "garlic": (149, 0.5, 0.1, 33.1, 1.0, 2.1, 6.4, 0.0, 0.017),
    "pepper": (20, 0.2, 0.0, 4.6, 2.4, 1.7, 0.9, 0.0, 0.003),
    "bell pepper": (20, 0.2, 0.0, 4.6, 2.4, 1.7, 0.9, 0.0, 0.003),
    "mushroom": (22, 0.3, 0.0, 3.3, 2.0, 1.0, 3.1, 0.0, 0.005),
    "celery": (16, 0.2, 0.0, 3.0, 1.3, 1.6, 0.7, 0.0, 0.08),
    "corn": (86, 1.2, 0.2, 19.0, 3.2, 2.7, 3.3, 0.0, 0.015),
    "zucchini": (17, 0.3, 0.1, 3.1, 2.5, 1.0, 1.2, 0.0, 0.008),
    "cauliflower": (25, 0.3, 0.1, 5.0, 1.9, 2.0, 1.9, 0.0, 0.03),
    "asparagus": (20, 0.1, 0.0, 3.9, 1.9, 2.1, 2.2, 0.0, 0.002),
    "green bean": (31, 0.1, 0.0, 7.0, 3.3, 3.4, 1.8, 0.0, 0.006),
    "cabbage": (25, 0.1, 0.0, 5.8, 3.2, 2.5, 1.3, 0.0, 0.018),
    "kale": (49, 0.9, 0.1, 8.8, 2.3, 3.6, 4.3, 0.0, 0.038),
    "dumpling": (206, 6.0, 2.0, 28.0, 2.0, 1.5, 8.0, 0.0, 0.45),
    "vermicelli": (335, 0.1, 0.0, 82.3, 0.0, 0.9, 0.2, 0.0, 0.01),
    "bean curd": (76, 4.8, 0.7, 1.9, 0.0, 0.3, 8.1, 0.0, 0.007),
    "beancurd": (76, 4.8, 0.7, 1.9, 0.0, 0.3, 8.1, 0.0, 0.007),
    "tofu": (76, 4.8, 0.7, 1.9, 0.0, 0.3, 8.1, 0.0, 0.007),
    "sesame oil": (884, 100.0, 14.2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "ginger": (80, 0.8, 0.2, 17.8, 1.7, 2.0, 1.8, 0.0, 0.013),
    "green onion": (32, 0.2, 0.0, 7.3, 2.3, 2.6, 1.8, 0.0, 0.016),
    "noodle": (138, 2.1, 0.3, 25.2, 0.6, 1.2, 4.5, 0.0, 0.234),
    "starch noodle": (335, 0.1, 0.0, 82.3, 0.0, 0.0, 0.1, 0.0, 0.01),
    "rice cake": (387, 0.7, 0.2, 85.5, 0.0, 1.6, 7.0, 0.0, 0.018),
    "kimchi": (15, 0.5, 0.1, 2.4, 1.1, 1.6, 1.1, 0.0, 0.498),
    "mayonnaise": (680, 74.9, 12.0, 0.6, 0.6, 0.0, 1.0, 0.0, 0.635),
    "chili oil": (884, 100.0, 13.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "ice tea": (33, 0.0, 0.0, 8.0, 8.0, 0.0, 0.0, 0.0, 0.004),
    "topo chico": (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.018),
    "lactaid": (52, 2.0, 1.2, 6.0, 6.0, 0.0, 3.3, 0.0, 0.05),
    "tropicana": (45, 0.2, 0.0, 10.4, 8.4, 0.2, 0.7, 0.0, 0.001),
    "ghirardelli": (500, 28.0, 17.0, 60.0, 50.0, 4.0, 5.0, 0.0, 0.02),
    "hot pot": (30, 1.0, 0.2, 4.0, 2.0, 0.5, 1.0, 0.0, 0.8),
    "soup base": (30, 1.0, 0.2, 4.0, 2.0, 0.5, 1.0, 0.0, 0.8),
    "napa": (16, 0.2, 0.0, 3.2, 1.4, 1.2, 1.2, 0.0, 0.009),
    "sujebi": (110, 1.0, 0.2, 22.0, 1.0, 1.0, 3.5, 0.0, 0.35),
    "quaker": (389, 6.9, 1.2, 66.3, 0.0, 10.6, 16.9, 0.0, 0.002),
    "foster farm": (120, 3.0, 0.8, 0.0, 0.0, 0.0, 21.0, 0.0, 0.34),
    "egg": (155, 11.0, 3.3, 1.1, 1.1, 0.0, 13.0, 0.0, 0.124),
    "chicken breast": (165, 3.6, 1.0, 0.0, 0.0, 0.0, 31.0, 0.0, 0.074),
    "chicken": (239, 13.6, 3.8, 0.0, 0.0, 0.0, 27.3, 0.0, 0.082),
    "ground beef": (254, 20.0, 7.7, 0.0, 0.0, 0.0, 17.2, 0.0, 0.075),
    "salmon": (208, 13.4, 3.1, 0.0, 0.0, 0.0, 20.4, 0.0, 0.059),
    "shrimp": (99, 0.3, 0.1, 0.2, 0.0, 0.0, 24.0, 0.0, 0.111),
    "pork": (242, 14.0, 5.2, 0.0, 0.0, 0.0, 27.3, 0.0, 0.062),
    "turkey": (189, 7.4, 2.0, 0.0, 0.0, 0.0, 29.3, 0.0, 0.068),
    "bacon": (541, 42.0, 14.0, 1.4, 0.0, 0.0, 37.0, 0.0, 1.717),
    "ham": (145, 5.5, 1.8, 1.5, 0.0, 0.0, 21.8, 0.0, 1.203),
    "hot dog": (290, 26.0, 9.6, 2.0, 0.0, 0.0, 10.3, 0.0, 1.09),
    "sausage": (301, 24.0, 8.5, 2.4, 0.0, 0.0, 19.0, 0.0, 0.87),
    "milk": (61, 3.3, 1.9, 4.8, 5.1, 0.0, 3.2, 0.0, 0.043),
    "butter": (717, 81.1, 51.4, 0.1, 0.1, 0.0, 0.9, 0.0, 0.643),
    "yogurt": (59, 0.4, 0.1, 3.6, 3.2, 0.0, 10.0, 0.0, 0.036),
    "cheddar": (403, 33.1, 21.1, 1.3, 0.5, 0.0, 24.9, 0.0, 0.621),
    "mozzarella": (280, 17.1, 10.9, 3.1, 1.0, 0.0, 27.5, 0.0, 0.627),
    "cream cheese": (342, 34.2, 19.2, 4.1, 3.2, 0.0, 5.9, 0.0, 0.321),
    "rice": (130, 0.3, 0.1, 28.2, 0.0, 0.4, 2.7, 0.0, 0.001),
    "bread": (265, 3.2, 0.7, 49.0, 5.0, 2.7, 9.4, 0.0, 0.491),
    "pasta": (131, 1.1, 0.2, 25.0, 0.6, 1.8, 5.0, 0.0, 0.001),
}

TAG_NAMES = _pairs(r"""
en:cookies = cookies
en:biscuits = cookies
en:chocolate-cookies = cookies
en:chips-and-fries = chips
en:crisps = chips
en:potato-chips = chips
en:tortilla-chips = chips
en:crackers = crackers
en:popcorn = popcorn
en:nuts = nuts
en:trail-mixes = trail mix
en:granola-bars = granola bar
en:energy-bars = energy bar
en:protein-bars = protein bar
en:pretzels = pretzels
en:milks = milk
en:whole-milk = milk
en:semi-skimmed-milk = milk
en:skimmed-milk = milk
en:yogurts = yogurt
en:greek-yogurts = yogurt
en:cheeses = cheese
en:cheddar = cheese
en:mozzarella = cheese
en:shredded-cheese = cheese
en:cream-cheeses = cream cheese
en:butters = butter
en:creams = cream
en:ice-creams-and-sorbets = ice cream
en:ice-creams = ice cream
en:cottage-cheeses = cottage cheese
en:sour-cream = sour cream
en:breads = bread
en:sandwich-bread = bread
en:white-breads = bread
en:whole-wheat-breads = bread
en:tortillas = tortilla
en:bagels = bagels
en:rolls = rolls
en:muffins = muffins
en:croissants = croissants
en:pita-breads = pita
en:english-muffins = english muffins
en:buns = buns
en:breakfast-cereals = cereal
en:granolas = granola
en:oatmeals = oatmeal
en:pastas = pasta
en:rices = rice
en:noodles = noodles
en:flour = flour
en:canned-foods = canned
en:canned-vegetables = canned vegetables
en:canned-beans = canned beans
en:canned-soups = canned soup
en:canned-fruits = canned fruit
en:canned-fish = canned fish
en:frozen-foods = frozen
en:frozen-vegetables = frozen vegetables
en:frozen-fruits = frozen fruit
en:frozen-pizzas = frozen pizza
en:frozen-meals = frozen meal
en:frozen-desserts = frozen dessert
en:frozen-fries = frozen fries
en:chicken = chicken
en:chicken-breasts = chicken breast
en:ground-beef = ground beef
en:beef = beef
en:pork = pork
en:turkey = turkey
en:bacon = bacon
en:sausages = sausage
en:hot-dogs = hot dog
en:deli-meats = deli meat
en:ham = ham
en:salami = salami
en:salmon = salmon
en:tuna = tuna
en:shrimp = shrimp
en:eggs = eggs
en:apples = apples
en:bananas = banana
en:oranges = orange
en:lemons = lemon
en:avocados = avocado
en:tomatoes = tomato
en:potatoes = potato
en:onions = onion
en:carrots = carrot
en:lettuce = lettuce
en:broccoli = broccoli
en:spinach = spinach
en:cucumbers = cucumber
en:peppers = pepper
en:mushrooms = mushroom
en:berries = berries
en:strawberries = strawberries
en:blueberries = blueberries
en:grapes = grapes
en:mangoes = mango
en:juices = juice
en:orange-juices = orange juice
en:apple-juices = apple juice
en:sodas = soda
en:waters = water
en:sparkling-water = sparkling water
en:energy-drinks = energy drink
en:sports-drinks = sports drink
en:coffees = coffee
en:teas = tea
en:plant-milks = plant milk
en:almond-milks = almond milk
en:oat-milks = oat milk
en:soy-milks = soy milk
en:coconut-milks = coconut milk
en:ketchup = ketchup
en:mustards = mustard
en:mayonnaises = mayonnaise
en:barbecue-sauces = bbq sauce
en:hot-sauces = hot sauce
en:salsas = salsa
en:pasta-sauces = pasta sauce
en:salad-dressings = salad dressing
en:soy-sauces = soy sauce
en:vinegars = vinegar
en:oils = oil
en:olive-oils = olive oil
en:hummus = hummus
en:peanut-butters = peanut butter
en:jams = jam
en:honeys = honey
en:syrups = syrup
en:pickles = pickles
en:sugars = sugar
en:chocolate = chocolate
en:chocolate-bars = chocolate bar
en:baking-mixes = baking mix
en:baby-foods = baby food
en:pet-foods = pet food
en:soups = soup
en:instant-noodles = instant noodles
en:ramen = ramen
en:waffles = waffle
en:pancakes = pancake
en:tortellini = tortellini
en:ravioli = ravioli
en:pizzas = pizza
en:burritos = burrito
en:hazelnut-spreads = hazelnut spread
en:chocolate-spreads = chocolate spread
en:cream-cheese-spreads = cream cheese spread
""")

FOREIGN_WORDS = _lines(r"""
und
mit
ohne
für
der
die
das
ein
eine
nicht
oder
aber
auch
nach
bei
auf
aus
vom
zum
zur
des
dem
den
über
unter
milch
brot
käse
wurst
fleisch
zucker
mehl
sahne
butter
joghurt
schokolade
kaffee
tee
wasser
saft
bier
wein
öl
essig
senf
flächen
reiniger
bodenreinigung
bürstenkopf
avec
sans
pour
dans
sur
sous
entre
lait
pain
fromage
beurre
crème
farine
sucre
chocolat
café
thé
eau
jus
vin
huile
vinaigre
moutarde
confiture
pâte
tartiner
noisettes
véritable
con
sin
para
leche
queso
mantequilla
azúcar
harina
aceite
vinagre
""")

NUTRIENTS = _lines("""
energy_kcal
fat
saturated_fat
carbohydrates
sugars
fiber
proteins
salt
sodium
""")

# nutrient ids of the food catalog; 1063 stands in for sugars where 2000 is absent
NUTRIENT_IDS = _pairs("""
1008 = energy_kcal
1004 = fat
1258 = saturated_fat
1005 = carbohydrates
2000 = sugars
1079 = fiber
1003 = proteins
1093 = sodium
""")
SUGARS_STAND_IN = 1063

# date formats in the order they are tried, and the order another entry point tries
DATE_FORMATS = _lines("""
yyyy-MM-dd
M/d/yyyy
M/d/yy
yyyy/MM/dd
d-M-yyyy
MMMM d, yyyy
MMM d, yyyy
""")

RECEIPT_DATE_FORMATS = _lines("""
M/d/yyyy
M/d/yy
M-d-yyyy
M-d-yy
yyyy-MM-dd
MMM d, yyyy
MMM d yyyy
MMMM d, yyyy
""")

# nutrient = daily target, low, high, unit
INTAKE = _pairs("""
calories = 1800 1600 2000 kcal
protein_g = 50 46 56 g
carbs_g = 275 225 325 g
fat_g = 78 65 97 g
fiber_g = 25 21 30 g
""")
