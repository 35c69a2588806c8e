"""Word lists whose entries decide results. Every function that uses one takes another in its place."""

# Phrases that tell a recipe page, in lower case, blanks included. One that is listed twice counts twice.
PHRASES = [
    "prep time", "cook time", "total time", "servings:", "servings ", "yield:", "yield ", "course:", "cuisine:", "calories:", "directions:", "instructions:", "method:",
    "teaspoon", "teaspoons", "tsp", "tablespoon", "tablespoons", "tbsp", "1/4 cup", "1/3 cup", "1/2 cup", "2/3 cup", "3/4 cup", " ounce", " ounces", " oz", "-oz ", " lb", " pounds ", " kilos ",
    " gram", " grams", " g ", " ml", " litre", " litres", "pinch of", "sea salt", "kosher salt", "ground black pepper", "freshly ground", "ground cumin", "ground cinnamon", "cinnamon stick", "ground ginger", "cloves of", "to taste",
    "unsalted butter", "1 medium", "1 large", "medium onion", "large onion", "small onion", "red onion", "beef stock", "chicken stock", "chicken broth", "fish stock", "seafood stock", "hard-boil", "boiling salted water",
    "bring to a boil", "diced ", "sprig ", "finely chopped ", "in a food processor", "chopped ", "minced ", "grated ", "peeled ", "gutted ", "crushed ", "finely crushed ", "steam ", "boil ",
    "add the", "add remaining", "boil the", "chop the", "cook the", "crack the", "cut into", "dice the", "discard the", "finely chop ", "coarsely chop", "grate the", "peel the", "not peeled", "prepare the",
    "juice the", "juice of", "pulse the", "mix the", "remove the", "rinse the", "rinse off", "salt the", "low heat", "medium heat", "high heat", "spread the", "stir the", "stir in", "stir into",
    "fill the", "fill a", "set aside", "sprinkle the", "pour the", "scrub the", "seal the", "drizzle the", "spread the", "slide the", "fold in", "fold into", "bake for", "hand mixer", "stand mixer",
    "cool completely", "beat together", "beat until", "before serving", "serve immediately", "top with", "pour batter", "pour into", "pour over", "spread batter", "mash the", "mash a", "season to taste", "bring to a ",
    "serve as a ", "mince the", "whiz the", "bake the", "cool the", "preheat the", "knead the", "knead", "prick the", "spoon the", "chill for", "stuff the", "line the", "skim the", "strain the", "strain sauce", "for serving", "tear up", "sauté ",
]
# Phrases that a page's regions are scored by.
REGION_PHRASES = [
    "teaspoon", "tablespoon", "tsp", "tbsp", "cup", "cups", " oz", " lb", " lbs", " ounce", " pound", "gram", " ml", "ingredients", "instructions", "directions", "method",
    "prep time", "cook time", "total time", "serves", "servings", "yield", "preheat", "bake", "boil", "simmer", "roast", "fry", "minutes", "whisk",
]
# Where a page's main content is looked for, in order: an attribute that holds a text, a class, an attribute that is there, or a tag.
REGIONS = [
    "[itemtype*='Recipe']", "[typeof*='Recipe']", ".wprm-recipe-container", ".tasty-recipes", ".mv-recipe-card", ".recipe-card", ".recipe", ".recipe-details", "[data-slot-rendered-recipe]", "[class*='hrecipe']",
    "article", "main", "[role='main']", ".post-content", ".entry-content", ".article-content", ".post-body", "body",
]
