"""Fixed values that results depend on."""

# Card-holder errors that do not count against a processor.
ERROR_BLACKLIST = (
    "Stolen card, pick up",
    "Expired card",
    "Insufficient card funds",
    "Blocked credit card. Contact the issuer before trying again.",
    "Card expired",
    "Card is blocked",
    "Card Mask Blacklisted: Card '430589******1006'",
    "Disabled card",
    "Invalid card expiry date",
    "Invalid card number",
    "Invalid credentials",
    "Lost Card",
    "No card record",
    "Restricted Card",
    "Transaction failed: Invalid card number",
    "Value '416598xxxxxx1534' is invalid. The combination of currency, card type and transaction type is not supported by a Merchant Acquirer relationship",
    "Value '462239xxxxxx7713' is invalid. The combination of currency, card type and transaction type is not supported by a Merchant Acquirer relationship",
    "Insufficient funds",
    "Over credit limit",
    "Card reported lost",
    "Card reported stolen",
    "Pick up card",
    "Card not active",
    "Card not yet effective",
    "Invalid card status",
    "Account closed",
    "Card suspended",
    "Invalid CVV / CVC",
    "Invalid PAN",
    "Invalid PIN",
    "Invalid card data",
    "Invalid card verification value",
    "Incorrect PIN",
    "Invalid card credentials",
    "Card not recognized",
)

# Category codes that models are trained on.
STATUS_CODES = {"approved": 0, "declined": 1, "filtered": 2}
IS_3D_CODES = {"f": 2, "t": 3}
CURRENCY_CODES = {"AUD": 0, "EUR": 1, "GBP": 2, "USD": 3, "JPY": 4, "NOK": 5, "SEK": 6, "ZAR": 7}
CARD_TYPE_CODES = {
    "American Express": 0,
    "ChinaUnionPay": 1,
    "Diners Club": 2,
    "Discover Network": 3,
    "Domestic Card Networks": 4,
    "Japan Credit Bureau": 5,
    "MasterCard": 6,
    "MasterCard Maestro": 7,
    "Visa": 8,
    "Any": 9,
    "HumoCard": 10,
}

# Report and learning parameters.
APPROVED, DECLINED = "approved", "declined"
MIN_PROCESSOR_ROWS = 10
POOR_MIN_ATTEMPTS, POOR_MAX_RATE = 500, 60.0
SCORES_PER_BIN, ROUTED_PER_BIN, ROUTING_THRESHOLD = 5000, 3, 0.80
HOLDOUT_FRACTION, SEED = 0.2, 42
TREES, TREE_DEPTH, LEARNING_RATE, SAMPLING = 200, 5, 0.05, 0.8
