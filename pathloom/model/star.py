"""The star-schema tables as nested resources."""

from pathloom.model.provider import Model

STAR = Model(
    "Star",
    """
    Resource - id:string resourceType:string
    Reference - reference:string
    Region Resource name:string
    Nation Resource name:string region:Reference<Region
    Customer Resource name:string nation:Reference<Nation balance:decimal segment:string
    Supplier Resource name:string nation:Reference<Nation balance:decimal
    Part Resource name:string brand:string type:string size:integer price:decimal
    Order Resource status:string total:decimal date:dateTime priority:string customer:Reference<Customer item:Order.item*
    Order.item - line:integer part:Reference<Part supplier:Reference<Supplier quantity:decimal price:decimal discount:decimal tax:decimal returnFlag:string lineStatus:string shipDate:dateTime
    Event Resource ts:dateTime user:integer type:string value:decimal props:string
    Document Resource text:string lang:string source:string chars:integer label:Document.label
    Document.label - quality:integer toxic:integer
    Conversation Resource turn:Conversation.turn*
    Conversation.turn - n:integer role:string text:string
    Page Resource url:string html:xhtml
    Vector Resource value:decimal* label:integer
    """,
)
