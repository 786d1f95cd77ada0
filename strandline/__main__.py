from strandline.api import main

raise SystemExit(main())
