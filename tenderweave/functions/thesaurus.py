"""Fixed values of the thesaurus and of the ordered category rules."""

from __future__ import annotations

# Phrases that a title may hold, and the terms that any of them adds.
THESAURUS: list[tuple[list[str], str]] = [
    (
        ["led road", "led street", "road luminaire", "street luminaire"],
        "led street light outdoor luminaire fixture highway street lighting road lighting municipal infrastructure energy efficient lumen lm/W watt "
        "IP66 CCT correlated colour temperature CRI colour rendering index lumen maintenance L70 L80 photometric efficacy BIS mandatory CRS "
        "procurement"
    ),
    (
        ["luminaire", "floodlight", "flood light", "high mast", "lumen output", "street lighting", "road lighting", "outdoor light"],
        "led street light outdoor luminaire fixture lighting energy efficient lumen photometric IP66 ingress protection watt CCT BIS CRS"
    ),
    (
        ["led lamp", "led bulb", "self ballasted"],
        "LED lamp LED bulb energy saving lamp general lighting BIS mandatory indoor LED"
    ),
    (
        ["general lighting", "light emitting diode", "led module", "led driver"],
        "LED lighting energy efficient lumen watt lm/W driver module"
    ),
    (
        ["lamp cap", "lamp holder", "lamp fitting", "lighting fitting"],
        "light fitting lamp holder socket luminaire component"
    ),
    (
        ["energy efficient", "induction motor", "squirrel cage"],
        "energy efficient motor IE1 IE2 IE3 IE4 efficiency class three phase motor BIS mandatory QCO procurement kW HP horsepower torque RPM speed"
    ),
    (
        ["rotating electrical machine", "rotating machine"],
        "electric motor induction motor synchronous motor generator alternator three phase motor single phase motor IE efficiency class kW HP torque "
        "RPM"
    ),
    (
        ["stepping motor", "stepper motor", "servo motor", "dc motor", "pm motor"],
        "motor servo stepper DC motor control positioning"
    ),
    (
        ["xlpe", "cross linked polyethylene", "cross-linked polyethylene"],
        "XLPE cable HV high voltage underground cable power transmission armoured sheathed cable HT cable 11kV 33kV 66kV 132kV medium voltage EHV"
    ),
    (
        ["pvc insulated", "pvc cable", "pvc sheathed"],
        "PVC cable electrical cable wiring conductor copper aluminium house wiring building wiring LV low voltage 1100V"
    ),
    (
        ["optical fibre", "optical fiber", "fibre cable"],
        "optical fibre cable communication cable data cable telecom broadband"
    ),
    (
        ["coaxial cable"],
        "coaxial cable RF cable communication cable antenna feeder"
    ),
    (
        ["winding wire", "enamelled wire", "winding copper"],
        "winding wire magnet wire enamelled conductor motor winding transformer winding"
    ),
    (
        ["cable tie", "cable management", "cable tray", "cable duct"],
        "cable management trunking tray duct installation accessories"
    ),
    (
        ["power transformer", "distribution transformer"],
        "power transformer distribution transformer step-up step-down KVA MVA oil-immersed winding losses efficiency voltage ratio"
    ),
    (
        ["dry-type transformer", "dry type transformer", "cast resin transformer"],
        "dry type transformer air cooled cast resin indoor installation KVA"
    ),
    (
        ["instrument transformer", "current transformer", "voltage transformer", "ct/pt"],
        "instrument transformer CT PT current transformer voltage transformer metering protection"
    ),
    (
        ["circuit breaker", "air circuit breaker", "acb", "vacuum circuit breaker", "vcb"],
        "circuit breaker ACB VCB switchgear protection interrupting capacity kA rated current"
    ),
    (
        ["miniature circuit breaker", "mcb"],
        "MCB miniature circuit breaker domestic wiring protection overload fault"
    ),
    (
        ["moulded case circuit breaker", "mccb"],
        "MCCB moulded case circuit breaker industrial protection overload"
    ),
    (
        ["residual current", "rccb", "rcd", "earth leakage"],
        "RCCB RCD earth leakage protection shock protection residual current device"
    ),
    (
        ["switchgear", "switchboard", "controlgear", "control gear"],
        "switchgear switchboard panel board LV MV distribution protection control"
    ),
    (
        ["motor control centre", "motor starter", "soft starter", "vfd", "variable frequency"],
        "motor control MCC variable frequency drive VFD soft starter DOL star delta"
    ),
    (
        ["surge protection", "surge arrester", "lightning arrester"],
        "surge protection SPD lightning arrester surge arrester overvoltage protection"
    ),
    (
        ["watt-hour meter", "watt hour meter", "energy meter", "kwh meter"],
        "energy meter electricity meter watt-hour meter kWh meter smart meter metering accuracy class BIS mandatory"
    ),
    (
        ["measuring instrument", "ammeter", "voltmeter", "wattmeter", "panel meter", "switchboard instrument"],
        "measuring instrument ammeter voltmeter wattmeter power factor meter frequency meter accuracy class panel meter"
    ),
    (
        ["household and similar electrical appliances", "household appliance", "domestic appliance"],
        "home appliance domestic appliance consumer electronics BIS mandatory CRS iron kettle mixer grinder fan heater toaster oven washing machine"
    ),
    (
        ["vacuum cleaner"],
        "vacuum cleaner household appliance floor care BIS mandatory"
    ),
    (
        ["microwave", "oven", "range hood", "exhaust fan"],
        "microwave oven cooking appliance kitchen appliance BIS mandatory"
    ),
    (
        ["air conditioner", "air conditioning", "heat pump", "room ac"],
        "air conditioner AC room cooler heat pump BEE star energy efficient"
    ),
    (
        ["refrigerator", "freezer", "cold storage"],
        "refrigerator freezer cooling appliance BEE star BIS mandatory"
    ),
    (
        ["water heater", "geyser", "immersion heater"],
        "water heater geyser immersion heater BIS mandatory household appliance"
    ),
    (
        ["medical electrical equipment", "medical device"],
        "medical device hospital equipment patient safety biomedical clinical IEC 60601 equivalent safety standard"
    ),
    (
        ["diagnostic", "patient monitoring", "defibrillator", "electrosurgical", "infusion pump", "syringe pump"],
        "medical equipment hospital clinical diagnostic patient care BIS standard"
    ),
    (
        ["personal protective equipment", "ppe", "safety helmet", "hard hat", "safety harness", "eye protection", "respiratory protection"],
        "PPE personal protective equipment safety BIS mandatory certification worker safety"
    ),
    (
        ["fire extinguisher", "fire fighting", "fire alarm", "fire detection"],
        "fire safety fire extinguisher fire alarm fire suppression BIS mandatory"
    ),
    (
        ["automobile", "automotive", "vehicle", "two-wheeler", "three-wheeler", "tyre", "tire"],
        "vehicle automobile car truck bus automotive tyre BIS mandatory CRS"
    ),
    (
        ["lpg", "liquefied petroleum gas", "gas cylinder", "pressure cylinder", "cng", "compressed natural gas"],
        "gas cylinder LPG CNG pressure vessel gas appliance BIS mandatory"
    ),
    (
        ["earthing", "grounding", "earth electrode"],
        "earthing grounding earth electrode earth pit electrical safety bonding LV MV"
    ),
    (
        ["wiring", "electrical installation", "conduit", "trunking", "cable tray", "socket outlet", "plug", "socket"],
        "electrical installation wiring conduit socket outlet plug BIS certification"
    ),
    (
        ["photovoltaic", "solar pv", "solar module", "solar cell", "solar panel", "solar inverter"],
        "solar photovoltaic PV panel module inverter renewable energy solar energy BIS mandatory certification"
    ),
    (
        ["wind turbine", "wind energy", "wind generator"],
        "wind turbine wind energy generator renewable energy"
    ),
    (
        ["pump", "centrifugal pump", "submersible pump", "reciprocating pump"],
        "pump centrifugal pump submersible pump water supply industrial pump BIS"
    ),
    (
        ["valve", "ball valve", "gate valve", "butterfly valve", "check valve"],
        "valve pipeline fitting fluid control water supply"
    ),
    (
        ["boiler", "pressure vessel", "steam"],
        "boiler pressure vessel steam industrial process plant"
    ),
    (
        ["information technology", "computer", "it equipment", "server", "networking", "router", "switch"],
        "information technology IT equipment computer server networking BIS standard"
    ),
    (
        ["telecommunication", "telecom", "modem", "telephone"],
        "telecom telecommunication communication equipment BIS standard"
    ),
    (
        ["cement", "concrete", "ready mixed", "ready-mixed"],
        "cement concrete building construction civil BIS mandatory CRS"
    ),
    (
        ["steel", "reinforcement", "rebar", "structural steel"],
        "steel reinforcement bar rebar structural steel building BIS mandatory"
    ),
    (
        ["brick", "tile", "ceramic", "flooring"],
        "brick tile ceramic flooring building material construction BIS"
    ),
    (
        ["paint", "varnish", "enamel", "lacquer"],
        "paint coating enamel protective coating BIS mandatory"
    ),
    (
        ["lubricant", "oil", "grease", "hydraulic fluid"],
        "lubricant oil grease industrial lubricant"
    ),
    (
        ["graphical symbol", "symbol for", "safety sign", "marking"],
        "symbol marking sign standard notation diagram"
    ),
    (
        ["test method", "methods of test", "methods of measurement", "testing of", "test procedure"],
        "test method measurement procedure testing standard laboratory"
    ),
]

# Ordered rules of categories, each with its phrases; numbers of standards count as phrases.
CATEGORY_RULES: list[tuple[list[str], str]] = [
    (["led road", "led street", "road luminaire", "street luminaire", "is 16107", "16107"], "Lighting & LED"),
    (["luminaire", "floodlight", "high mast", "led lamp", "led bulb", "self ballasted", "lumen output", "led module", "light emitting diode",
      "is 10322", "10322", "is 16101", "16101", "is 15885", "15885", "street lighting", "is 1944", "1944"], "Lighting & LED"),
    (["solar pv", "photovoltaic", "solar cell", "solar module", "solar panel", "solar inverter", "wind turbine",
      "renewable energy"], "Renewable Energy"),
    (["medical electrical", "medical device", "clinical", "patient monitoring", "defibrillator", "infusion pump", "electrosurgical",
      "diagnostic imaging", "hospital equipment"], "Medical Electrical Equipment"),
    (["energy efficient induction motor", "squirrel cage motor", "is 12615", "12615"], "Motors & Rotating Machines"),
    (["rotating electrical machine", "induction motor", "synchronous motor", "dc motor", "servo motor", "stepper motor", "fractional horsepower",
      "motor winding", "is 4722", "4722", "is 15999", "15999", "is/iec 60034"], "Motors & Rotating Machines"),
    (["pvc insulated cable", "xlpe cable", "cross linked polyethylene", "winding wire", "enamelled wire", "optical fibre cable", "coaxial cable",
      "house wiring cable", "power cable", "armoured cable", "is 694", "694", "is 1554", "1554", "is 7098", "7098"], "Cables & Wires"),
    (["power transformer", "distribution transformer", "instrument transformer", "current transformer", "voltage transformer",
      "dry-type transformer", "circuit breaker", "switchgear", "switchboard", "controlgear", "motor control centre", "motor starter",
      "surge arrester", "is 2026", "2026", "is 11171", "11171", "is 8623", "8623", "is 4237"], "Power Equipment"),
    (["pump", "centrifugal pump", "submersible pump", "valve", "boiler", "compressor", "pressure vessel", "pipeline"], "Pumps & Fluid Equipment"),
    (["personal protective equipment", "ppe", "safety helmet", "hard hat", "safety harness", "fire extinguisher", "fire alarm"], "Safety Equipment"),
    (["cement", "concrete", "reinforcement", "structural steel", "rebar", "brick", "tile", "plywood",
      "building material"], "Civil & Construction Materials"),
    (["food", "beverage", "edible oil", "grain", "cereal", "milk", "dairy", "spice", "drinking water", "potable water", "agriculture", "fertilizer",
      "pesticide"], "Food & Agriculture"),
    (["textile", "fibre", "fabric", "yarn", "wool", "cotton", "silk", "man-made fibre", "technical textile"], "Textiles"),
    (["paint", "varnish", "enamel", "coating", "adhesive", "sealant", "lubricant", "grease"], "Chemicals & Coatings"),
    (["fastener", "bolt", "nut", "screw", "bearing", "gear", "spring", "chain", "forging", "casting"], "Mechanical Components"),
    (["gas cylinder", "lpg", "cng", "acetylene", "pressure regulator", "gas appliance", "gas meter"], "Gas & Pressure Equipment"),
    (["automobile", "vehicle", "tyre", "tire", "automotive", "two-wheeler", "three-wheeler", "engine emission"], "Automotive"),
    (["information technology", "computer", "it equipment", "telecommunication", "telecom", "modem", "router", "server"], "IT & Telecom"),
    (["furniture", "chair", "table", "desk", "cabinet", "office furniture", "steel furniture"], "Furniture"),
    (["water supply", "sanitation", "plumbing", "sewage", "effluent", "water treatment", "drinking water system",
      "wastewater"], "Water & Sanitation"),
    (["packaging", "container", "drum", "carton", "corrugated"], "Packaging"),
    (["wiring", "socket outlet", "plug", "energy meter", "earthing", "surge protection", "switchboard", "distribution board", "watt-hour meter",
      "measuring instrument"], "Electrical Installation & Safety"),
]
