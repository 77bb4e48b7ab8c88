"""Extraction patterns (X1-X17) and keyword lists.

Fixed values: these patterns and words must equal the rules they express. All are
case-insensitive but VIN and PRICE; the value is always in group 1. The dialect is the
one that Java and RE2 share.
"""

VIN = r"\b([A-HJ-NPR-Z0-9]{17})\b"
PRICE = r"\$\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]{2})?)"
MILEAGE = r"(?i)\b([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*(?:mi|miles?)\b"
STOCK = r"(?i)(?:Stock\s*(?:#|Number|No\.?)\s*[:#]?\s*([A-Za-z0-9\-]+))"
CONDITION = r"(?i)\b(New|Used|Pre[-\s]?Owned|Certified Pre[-\s]?Owned|CPO)\b"
AVAILABILITY = r"(?i)\b(In Stock|Available|In Transit|On the Way|Sold|Reserved|Coming Soon|Arriving Soon|Order Yours)\b"
BODY_STYLE_LABEL = r"(?i)Body\s*Style[:\s]*([A-Za-z0-9 \-/]+)"
BODY_STYLE_VALUE = r"(?i)\b(SUV|Sedan|Truck|Pickup|Van|Hatchback|Wagon|Crossover|Sport Utility)\b"
EXTERIOR_COLOR = r"(?i)(?:Exterior\s*Color|Ext\.?\s*Color)[:\s]*([A-Za-z0-9 /&\-]+)"
INTERIOR_COLOR = r"(?i)(?:Interior\s*Color|Int\.?\s*Color)[:\s]*([A-Za-z0-9 /&\-]+)"
TRANSMISSION = r"(?i)(?:Transmission|Trans\.?)[:\s]*([A-Za-z0-9 \-/]+)"
ENGINE = r"(?i)(?:Engine|Motor)[:\s]*([A-Za-z0-9 .+/&\-]+)"
FUEL_LABEL = r"(?i)(?:Fuel\s*Type|Fuel)[:\s]*([A-Za-z0-9 /+\-]+)"
FUEL_VALUE = r"(?i)\b(Electric|EV|BEV|Hybrid|Plug[-\s]?In Hybrid|PHEV|Gasoline|Gas|Diesel|Flex Fuel)\b"
DRIVETRAIN_VALUE = r"(?i)\b(AWD|FWD|RWD|4WD|4x4|All[-\s]?Wheel Drive|Front[-\s]?Wheel Drive|Rear[-\s]?Wheel Drive|Four[-\s]?Wheel Drive|4MATIC|4MOTION|Quattro|xDrive)\b"
DRIVETRAIN_LABEL = r"(?i)(?:Drivetrain|Drive\s*Type|Drive|Driveline|Powertrain)[:\s]*([A-Za-z0-9 \-/]+)"
ELECTRIC = r"(?i)\b(Electric|EV|BEV|Battery Electric|Zero Emission|ZEV|Plug[-\s]?In Hybrid|PHEV)\b"
MAKE_MODEL = r"(?i)\b(Tesla|Hyundai|Kia|Ford|Chevrolet|Nissan|BMW|Mercedes|Audi|Toyota|Honda|Mazda|Subaru|Volvo|Polestar|Rivian|Lucid|Genesis|Cadillac|Lincoln|Jeep|Ram|GMC|Buick|Chrysler|Dodge|INFINITI|Acura|Lexus|Jaguar|Land Rover|MINI|Mitsubishi|Porsche)\s+([A-Z0-9\s]+?)(?:\s|$|,|\d)"
YEAR = r"\b((?:19|20)\d{2})\b"

#: Fixed: makes in the order in which titles are searched for them.
MAKES = (
    "Tesla", "Hyundai", "Kia", "Ford", "Chevrolet", "Chevy", "Nissan", "BMW", "Mercedes-Benz", "Mercedes", "Audi", "Volkswagen", "VW", "Toyota", "Honda", "Mazda", "Subaru", "Volvo", "Polestar", "Rivian", "Lucid", "Fisker", "Genesis", "Cadillac", "Lincoln", "Jeep", "Ram", "GMC", "Buick", "Chrysler", "Dodge", "INFINITI", "Acura", "Lexus", "Jaguar", "Land Rover", "MINI", "Mitsubishi", "Porsche", "Alfa Romeo", "Fiat", "Maserati",
)

#: Fixed: drivetrain words in the order in which they are searched, and what they mean.
DRIVETRAINS = (
    ("awd", "AWD"), ("all wheel drive", "AWD"), ("xdrive", "AWD"), ("4matic", "AWD"), ("4motion", "AWD"), ("quattro", "AWD"),
    ("fwd", "FWD"), ("front wheel drive", "FWD"), ("rwd", "RWD"), ("rear wheel drive", "RWD"), ("4wd", "4WD"), ("4x4", "4WD"), ("four wheel drive", "4WD"),
)

#: Fixed: words that hint at an electric vehicle anywhere in a text.
EV_HINTS = ("electric", "ev", "battery", "plug-in", "plugin", "phev", "bev", "tesla", "rivian", "lucid", "electric vehicle", "zero emission", "zero-emission", "electric drive", "electric motor")

#: Fixed: keywords by field.
KEYWORDS = {
    "name": ("New", "Used", "Certified"),
    "price": ("MSRP", "Internet Price", "Sale Price", "Our Price", "Dealer Price", "No Bull Price", "One Price", "E-Price", "Request ePrice", "$"),
    "vin": ("VIN", "Vin:", "Vehicle Identification Number"),
    "stock_number": ("Stock #", "Stock:", "Stock Number", "Stk #"),
    "mileage": ("Mileage", "Odometer", "Miles", "mi."),
    "condition": ("Condition", "New", "Used", "Pre-Owned", "Certified Pre-Owned", "CPO"),
    "fuel_type": ("Fuel Type", "Fuel", "Engine", "Hybrid", "Plug-In Hybrid", "PHEV", "Electric", "EV", "Battery Electric", "BEV"),
    "availability": ("In Stock", "Available", "In Transit", "On the Way", "Sold", "Reserved", "Order Yours"),
    "body_style": ("Body Style", "Body:", "Sedan", "SUV", "Truck", "Hatchback", "Wagon"),
    "colors": ("Exterior Color", "Interior Color", "Ext. Color", "Int. Color", "Exterior:", "Interior:"),
}
